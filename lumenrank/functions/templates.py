"""Query templates: variables, sections, and the functions toJson, join and url. Rendered on the driver, once a query."""

from __future__ import annotations

import json
import re
from urllib.parse import quote_plus

_TAG = re.compile(r"\{\{\{(.+?)\}\}\}|\{\{([#^/&!]?)(.+?)\}\}", re.S)
_JOIN = re.compile(r"join\s+delimiter='(.*)'$", re.S)
ENCODERS = {"application/json": lambda s: json.dumps(s, ensure_ascii=False)[1:-1], "text/plain": str, "application/x-www-form-urlencoded": quote_plus}


def _say(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return ", ".join(map(_say, value)) if isinstance(value, list) else str(value)


def _find(name: str, scopes: list):
    if name == ".":
        return scopes[-1]
    head, *rest = name.split(".")
    value = next((s[head] for s in reversed(scopes) if isinstance(s, dict) and head in s), None)
    for part in rest:
        if isinstance(value, (list, tuple)):
            value = len(value) if part == "size" else value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def _parse(text: str) -> list:
    stack: list[tuple[str, str, list]] = [("", "", [])]
    at = 0
    for m in _TAG.finditer(text):
        stack[-1][2].append(text[at : m.start()])
        at = m.end()
        kind, name = ("&", m[1].strip()) if m[1] else (m[2], m[3].strip())
        if kind in "#^" and kind:
            stack.append((kind, name, []))
        elif kind == "/":
            opened, was, body = stack.pop()
            if not opened or was != name:
                raise ValueError(f"unexpected end of section [{name}]")
            stack[-1][2].append((opened, name, body))
        elif kind != "!":
            stack[-1][2].append((kind or "var", name, None))
    if len(stack) > 1:
        raise ValueError(f"section [{stack[-1][1]}] is not closed")
    stack[0][2].append(text[at:])
    return stack[0][2]


def _identifier(body: list, what: str) -> str:
    text = "".join(x for x in body if isinstance(x, str)).strip()
    names = [x[1] for x in body if not isinstance(x, str)]
    if names or not text or len(text.split()) != 1:
        raise ValueError(f"function [{what}] needs one identifier")
    return text


def _render(nodes: list, scopes: list, encode) -> str:
    out = []
    for node in nodes:
        if isinstance(node, str):
            out.append(node)
            continue
        kind, name, body = node
        if kind == "var":
            out.append(encode(_say(_find(name, scopes))))
        elif kind == "&":
            out.append(_say(_find(name, scopes)))
        elif kind == "#" and name == "toJson":
            value = _find(_identifier(body, name), scopes)
            out.append(json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict, tuple)) else _say(value))
        elif kind == "#" and (name == "join" or _JOIN.match(name)):
            m = _JOIN.match(name)
            value = _find(_identifier(body, "join"), scopes)
            out.append(encode((m[1] if m else ",").join(map(_say, value)) if isinstance(value, (list, tuple)) else _say(value)))
        elif kind == "#" and name == "url":
            out.append(quote_plus(_render(body, scopes, str)))
        else:
            value = _find(name, scopes)
            shown = value not in (None, False, "") and value != [] and value != {}
            if kind == "^":
                out.append("" if shown else _render(body, scopes, encode))
            elif isinstance(value, (list, tuple)):
                out.extend(_render(body, [*scopes, x], encode) for x in value)
            elif shown:
                out.append(_render(body, [*scopes, value], encode))
    return "".join(out)


def render(template: str, params: dict, mime: str = "application/json") -> str:
    if mime not in ENCODERS:
        raise ValueError(f"no encoder for [{mime}]")
    return _render(_parse(template), [params], ENCODERS[mime])
