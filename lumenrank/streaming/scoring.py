"""Scores a stream of queries against a corpus, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import models, ranking
from ..sources.corpus import Corpus


def score_stream(queries: DataFrame, corpus: Corpus, model: models.Model, sink: Callable[[DataFrame, int], None], k: int = 10, max_queries: int = 1000, candidates: Callable[[dict], dict] | None = None) -> DataStreamWriter:
    """A writer that hands ``sink`` the top ``k`` of each batch's queries ``(qid, params map<string,string>)``.

    A batch must hold at most ``max_queries`` distinct queries, which bounds what comes to the driver; a larger one fails, so limit the source's rate.
    """

    def batch(rows: DataFrame, number: int) -> None:
        asked = rows.groupBy("qid").agg(F.first("params").alias("params")).limit(max_queries + 1).collect()
        if len(asked) > max_queries:
            raise ValueError(f"batch {number} has more than {max_queries} queries")
        if not asked:
            return
        params = {r["qid"]: dict(r["params"]) for r in asked}
        wanted = {q: candidates(p) for q, p in params.items()} if candidates else None
        scored, _ = ranking.ltr_query(corpus, params, model, candidates=wanted, keep=[])
        sink(ranking.top(scored, k, id_col=corpus.id_col).select("qid", corpus.id_col, "score", "rank"), number)

    return queries.writeStream.foreachBatch(batch)
