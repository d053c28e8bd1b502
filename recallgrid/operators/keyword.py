"""The inverted keyword index as a table of distinct (token, drawer_id), and searches over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import dates, text


def postings(drawers: DataFrame, stopwords: Sequence[str] = text.STOPWORDS) -> DataFrame:
    return drawers.select(F.explode(F.array_distinct(text.tokens(F.col("document"), stopwords))).alias("token"), "drawer_id")


def scope(drawers: DataFrame, wing: str | None = None, room: str | None = None, since: int | None = None, until: int | None = None, as_of: int | None = None) -> DataFrame:
    """Plain predicates on columns, which reach the scan. as_of needs valid_from and valid_to or takes filed_day as the start."""
    out = drawers
    for name, wanted in (("wing", wing), ("room", room)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    if since or until:
        out = out.where(dates.within(F.col("filed_day"), since, until))
    if as_of:
        start = F.col("valid_from") if "valid_from" in out.columns else F.col("filed_day")
        end = F.col("valid_to") if "valid_to" in out.columns else F.lit(None).cast("int")
        out = out.where(dates.valid_on(start, end, F.lit(as_of)))
    return out


def search(drawers: DataFrame, keywords: Sequence[str], mode: str = "all", stopwords: Sequence[str] = text.STOPWORDS, **limits) -> DataFrame:
    """The drawers in scope that have all (or any) of the keywords, or a token with each of them as prefix.

    Keywords are trimmed and lower-cased but not split: one of several words or a stopword matches nothing. With
    'all' and 'prefix' a blank keyword gives no rows; 'any' ignores it. No keywords: all drawers in scope.
    """
    if mode not in ("all", "any", "prefix"):
        raise ValueError(f"mode {mode!r}")
    inside = scope(drawers, **limits)
    wanted = sorted({k.strip().lower() for k in keywords})
    if not wanted:
        return inside
    if mode != "any" and "" in wanted:
        return inside.where(F.lit(False))
    wanted = [k for k in wanted if k]
    if not wanted:
        return inside.where(F.lit(False))
    # The set of a drawer's tokens is built and tested within its row: no shuffle, and no row for each token.
    own = F.array_distinct(text.tokens(F.col("document"), stopwords))
    if mode == "any":
        return inside.where(F.arrays_overlap(own, F.array(*map(F.lit, wanted))))
    if mode == "all":
        return inside.where(F.size(F.array_intersect(own, F.array(*map(F.lit, wanted)))) == len(wanted))

    def has(prefix: str) -> Column:
        return F.exists(own, lambda t: t.startswith(prefix))

    met = has(wanted[0])
    for k in wanted[1:]:
        met = met & has(k)
    return inside.where(met)


def lookup(index: DataFrame, keywords: Sequence[str], mode: str = "all") -> DataFrame:
    """drawer_id of search(), from a stored table of postings: the token predicate prunes row groups sorted by token."""
    wanted = sorted({k.strip().lower() for k in keywords})
    if not wanted or (mode != "any" and "" in wanted):
        return index.select("drawer_id").where(F.lit(False))
    if mode == "prefix":
        which = F.array_compact(F.array(*[F.when(F.col("token").startswith(k), F.lit(k)) for k in wanted]))
        found = index.select("drawer_id", F.explode(which).alias("k"))
    else:
        found = index.where(F.col("token").isin(*wanted)).select("drawer_id", F.col("token").alias("k"))
    if mode == "any":
        return found.select("drawer_id").distinct()
    return found.groupBy("drawer_id").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(wanted)).select("drawer_id")


def write_index(drawers: DataFrame, path: str, partitions: int | None = None) -> None:
    """The postings, sorted by token across files, so that a lookup reads few row groups."""
    index = postings(drawers)
    ranged = index.repartitionByRange(partitions, "token", "drawer_id") if partitions else index.repartitionByRange("token", "drawer_id")
    ranged.sortWithinPartitions("token", "drawer_id").write.mode("overwrite").parquet(path)


def remove(index: DataFrame, drawer_ids: DataFrame) -> DataFrame:
    return index.join(drawer_ids.select("drawer_id"), "drawer_id", "left_anti")


def stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("postings"), F.countDistinct("token").alias("tokens"), F.countDistinct("drawer_id").alias("drawers"))


def hottest(index: DataFrame, k: int) -> DataFrame:
    """The k tokens in most drawers; ties by token."""
    return index.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def bitmap_counts(index: DataFrame, numbers: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """For each keyword its number of drawers, counted through compressed bitmaps of drawer numbers (drawer_id, n)."""
    found = index.where(F.col("token").isin(*keywords)).join(numbers, "drawer_id")
    parts = found.groupBy("token", F.bitmap_bucket_number("n").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    return parts.groupBy("token").agg(F.sum(F.bitmap_count("bits")).alias("drawers"))
