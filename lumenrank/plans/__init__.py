"""Plans that join queries to documents."""
