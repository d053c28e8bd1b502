"""Fusing ranked lists: reciprocal ranks, container boosts, BM25, and the boosts of retrieval benchmarks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text

RRF_K = 60
WEIGHTS = {"drawer": 1.0, "room": 0.3, "hall": 0.2, "wing": 0.1}


def ranked(scores: DataFrame, by: Sequence[str] = ("model",), score: str = "similarity", id_col: str = "vec_id") -> DataFrame:
    """rank from 0 within each of `by`; ties by id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_col)) - 1)


def rrf(lists: DataFrame, weight: float = 1.0, id_col: str = "vec_id", models: Sequence[str] = ()) -> DataFrame:
    """lists: model, id_col, rank. id_col, rrf_score and source_models, in the order of `models` (else by name)."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model")) if models else F.lit(0)
    return lists.groupBy(id_col).agg(
        F.sum(F.lit(weight) / (RRF_K + F.col("rank"))).alias("rrf_score"),
        F.transform(F.sort_array(F.collect_set(F.struct(place.alias("place"), F.col("model").alias("model")))), lambda s: s["model"]).alias("source_models"),
    )


def container_boost(containers: DataFrame, weights: Mapping[str, float] = WEIGHTS, top: int = 15, id_col: str = "vec_id") -> DataFrame:
    """containers: level, container, score, member_ids. Each level's best `top` give their members weight / (60 + rank)."""
    first = ranked(containers, ("level",), "score", "container").where(F.col("rank") < top)
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    each = first.select(F.explode("member_ids").alias(id_col), (weight[F.col("level")] / (RRF_K + F.col("rank"))).alias("b"))
    return each.groupBy(id_col).agg(F.sum("b").alias("boost"))


def composite(hits: DataFrame, boosts: DataFrame, weight: float = 1.0, id_col: str = "vec_id") -> DataFrame:
    """hits with score = weight * similarity + boost (0 where a hit has none)."""
    return hits.join(boosts, id_col, "left").withColumn("score", weight * F.col("similarity") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def bm25(drawers: DataFrame, terms: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """drawer_id, score of the drawers that have a term. Texts are cut into tokens once; no row for each token.

    The counts, a row of numbers for each drawer, are checkpointed: totals and scores are both made of them.
    """
    from recallgrid.operators.graph import _cut

    cut = drawers.select("drawer_id", F.explode(F.array(text.tokens(F.col("document")))).alias("own"))  # explode keeps the tokens from being made for each use

    def times(term: str) -> Column:
        return F.size(F.filter("own", lambda t: t == term))

    counts = [times(x).alias(f"f{i}") for i, x in enumerate(terms)]
    rows = _cut(cut.select("drawer_id", F.size("own").alias("len"), *counts))
    n_terms = range(len(terms))
    total = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in n_terms])
    joined = rows.where(" OR ".join(f"f{i} > 0" for i in n_terms)).join(F.broadcast(total))  # one row of totals
    score = F.lit(0.0)
    for i in n_terms:
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.select("drawer_id", score.alias("score"))


def overlap(document: Column, terms: Sequence[str]) -> Column:
    """The share of the terms that are among the document's tokens."""
    return F.size(F.array_intersect(F.array_distinct(text.tokens(document)), F.array(*map(F.lit, terms)))) / F.lit(float(len(terms)))


def overlap_fused(distance: Column, share: Column, weight: float = 0.3) -> Column:
    return distance * (1 - weight * share)


def soft_boost(distance: Column, flag: Column, factor: float = 0.8) -> Column:
    """Rooms .8; halls .75, .9 and .85 by what matched; diary layers .8."""
    return F.when(flag, distance * factor).otherwise(distance)


def phrase_boost(distance: Column, document: Column, phrases: Sequence[str], weight: float) -> Column:
    """Quoted phrases weigh .6 and names .4, by the share of them that stand in the document."""
    if not phrases:
        return distance
    low = F.lower(document)
    return distance * (1 - F.lit(weight) * text.hits(low, [p.lower() for p in phrases]) / len(phrases))


def dialog_distance(distance: Column, document: Column, terms: Sequence[str], names: Sequence[str] = (), phrases: Sequence[str] = (), weights: Sequence[float] = (0.5, 0.6, 0.2)) -> Column:
    """The distance of a question within one dialog: nearer by its terms other than people's names, then quoted phrases, then names.

    All turns of a dialog name its people, so that their names among the terms would tell nothing apart.
    """
    people = {n.lower() for n in names}
    told = [t for t in terms if t.lower() not in people]
    fused = overlap_fused(distance, overlap(document, told), weights[0]) if told else distance
    return phrase_boost(phrase_boost(fused, document, phrases, weights[1]), document, names, weights[2])


def hybrid(hits: DataFrame, lexical: DataFrame, weight: float = 0.6, id_col: str = "drawer_id") -> DataFrame:
    """Vector similarity as it is (1 - distance, not below 0) and BM25 over its maximum, weighted."""
    top = lexical.agg(F.max("score").alias("top"))
    joined = hits.join(lexical.select(id_col, F.col("score").alias("bm25")), id_col, "left").join(F.broadcast(top), how="left")
    part = F.when(F.col("top") > 0, F.coalesce("bm25", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return joined.withColumn("hybrid", weight * F.greatest(F.lit(0.0), F.col("similarity")) + (1 - weight) * part).drop("top", "bm25")


def closet_boost(hits: DataFrame, closets: DataFrame, boosts: Sequence[float] = (0.4, 0.25, 0.15, 0.08, 0.04), id_col: str = "drawer_id") -> DataFrame:
    """closets: source_file and rank from 0. A closet raises its file's hits and hides none; matched_via says which."""
    amount = F.coalesce(F.get(F.array(*map(F.lit, boosts)), F.col("closet_rank")), F.lit(0.0))
    best = closets.groupBy("source_file").agg(F.min("rank").alias("closet_rank"))
    return hits.join(best, "source_file", "left").withColumn("score", F.col("similarity") + amount).withColumn("matched_via", F.when(amount > 0, "drawer+closet").otherwise("drawer")).drop("closet_rank")


def within_distance(hits: DataFrame, most: float) -> DataFrame:
    return hits.where(1 - F.col("similarity") <= most)


def neighbours(hits: DataFrame, drawers: DataFrame, reach: int = 1) -> DataFrame:
    """hits (source_file, chunk_index) with the text of the chunks around, drawer_index and total_drawers."""
    around = hits.select("source_file", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("at"))
    parts = around.join(drawers.select("source_file", F.col("chunk_index").alias("at"), "document"), ["source_file", "at"])
    joined = parts.groupBy("source_file", "chunk_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "document"))), lambda s: s["document"]), "\n\n").alias("text"))
    totals = drawers.groupBy("source_file").agg(F.count("*").alias("total_drawers"))
    return joined.join(totals, "source_file").select("source_file", F.col("chunk_index").alias("drawer_index"), "text", "total_drawers")
