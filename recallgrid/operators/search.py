"""The search that joins the others: keyword and time candidates, vectors by model, fused ranks, boosts, compression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import fusion, keyword, vector


@dataclass
class Answer:
    """Hits in order, and how they were found."""

    hits: DataFrame
    filters: Mapping[str, object] = field(default_factory=dict)
    fan_out: Sequence[str] = ()
    reranked: bool = False


def hybrid_search(
    drawers: DataFrame, vectors: Mapping[str, DataFrame], query: Mapping[str, Sequence[float]] | None = None, keywords: Sequence[str] = (), mode: str = "all", n: int = 5,
    containers: DataFrame | None = None, graph_candidates: DataFrame | None = None, graph_mode: str = "union", max_distance: float | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, **limits,
) -> Answer:
    """drawers; vectors (drawer_id, v) and the query's vector by model. Without a query, candidates by day, newest first.

    Candidates (keywords, scope, times) are a semi-join below the ranking, so that a filter never costs recall.
    Graph candidates join them ('union') or, without other filters, replace them; 'add' only adds to a filter. With
    several models, ranks are fused; with one, the similarity is; container boosts come on top. A reranker that
    raises leaves the order as it was.
    """
    filtered = bool(keywords) or any(limits.get(k) for k in ("since", "until", "as_of", "wing", "room"))
    inside = keyword.search(drawers, keywords, mode, **limits) if keywords else keyword.scope(drawers, **limits)
    candidates = inside.select("drawer_id") if filtered else None
    if graph_candidates is not None and (candidates is not None or graph_mode == "union"):
        candidates = graph_candidates.select("drawer_id") if candidates is None else candidates.union(graph_candidates.select("drawer_id")).distinct()
    if not query:
        chosen = inside if candidates is None else drawers.join(candidates, "drawer_id", "left_semi")
        return Answer(chosen.withColumn("similarity", F.lit(None).cast("double")).orderBy(F.desc("filed_day"), "drawer_id").limit(n), limits)
    overfetch = max(3 * n, 15) if len(query) > 1 else n
    lists = None
    for model, q in query.items():
        found = vector.knn(vectors[model], q, overfetch, candidates, "drawer_id").withColumn("model", F.lit(model))
        lists = found if lists is None else lists.union(found)
    if max_distance is not None:
        lists = fusion.within_distance(lists, max_distance)
    if len(query) > 1:
        scored = fusion.rrf(fusion.ranked(lists, id_col="drawer_id"), id_col="drawer_id", models=list(query))
        best = lists.groupBy("drawer_id").agg(F.max("similarity").alias("similarity"))
        scored = scored.join(best, "drawer_id").withColumn("score", F.col("rrf_score"))
    else:
        scored = lists.withColumn("score", F.col("similarity"))
    if containers is not None:
        boost = fusion.container_boost(containers, id_col="drawer_id")
        scored = scored.join(boost, "drawer_id", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    hits = scored.join(drawers, "drawer_id").orderBy(F.desc("score"), "drawer_id").limit(n)
    done = False
    if rerank is not None:
        try:
            again = rerank(hits)
            again.schema  # noqa: B018  a reranker that doesn't fit fails here
            hits, done = again, True
        except Exception:  # any reranker's failure: the hits stand as they are
            done = False
    return Answer(hits, limits, list(query), done)


def memories(answer: Answer) -> DataFrame:
    """An answer's hits in the shape that callers get: text, wing, room, source_file, similarity, in order."""
    return answer.hits.select(F.col("document").alias("text"), "wing", "room", "source_file", "similarity")


def report(answer: Answer, question: str) -> str:
    """An answer (its top n only) as text for a terminal."""
    rows = memories(answer).collect()
    if not rows:
        return f'No results found for: "{question}"'
    asked = [f"{k}: {v}" for k, v in answer.filters.items() if v is not None]
    lines = [f'Results for: "{question}"', *asked]
    for i, r in enumerate(rows, 1):
        close = "" if r.similarity is None else f"  ({r.similarity:.3f})"
        lines += ["", f"[{i}] {r.wing} / {r.room}{close}", f"    {r.source_file}", *(f"    {x}" for x in (r.text or "").split("\n"))]
    return "\n".join(lines)


def lexical_rerank(terms: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A reranker for want of a model: the share of the terms in the text, then the score."""
    return lambda hits: hits.withColumn("rerank_score", fusion.overlap(F.col("document"), terms)).orderBy(F.desc("rerank_score"), F.desc("score"), "drawer_id")
