"""The temporal knowledge graph: merging evidence, facts as of a day, statistics, claims against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.dates import valid_on
from recallgrid.functions.text import entity_id


def merge(claims: DataFrame) -> DataFrame:
    """Open claims (subject, predicate, object, confidence, source) as triples with confidence, n, sources.

    A single claim keeps its confidence; several join as 1 - prod(1 - c), c at most .99 and .5 where 0 or unknown.
    """
    c = F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 0.5).otherwise(F.least(F.col("confidence"), F.lit(0.99)))
    grouped = claims.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"), F.max("confidence").alias("one"), F.sum(F.log1p(-F.greatest(c, F.lit(0.0)))).alias("logs"), F.sort_array(F.collect_set("source")).alias("sources"))
    return grouped.select("subject", "predicate", "object", F.when(F.col("n") == 1, F.col("one")).otherwise(1 - F.exp("logs")).alias("confidence"), "n", "sources")


def facts(triples: DataFrame, entity: str, direction: str = "out", as_of: str | None = None) -> DataFrame:
    """direction, subject, predicate, object, valid_from, valid_to, current of an entity's facts; a self-loop counts on both sides."""
    wanted = entity.lower().replace(" ", "_").replace("'", "")
    parts = []
    for way, own in (("out", "subject"), ("in", "object")):
        if direction in (way, "both"):
            found = triples.where(entity_id(F.col(own)) == wanted)
            if as_of:
                found = found.where(valid_on(F.col("valid_from"), F.col("valid_to"), F.lit(as_of)))
            parts.append(found.select(F.lit(way).alias("direction"), "subject", "predicate", "object", "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def relationship(triples: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    wanted = predicate.lower().replace(" ", "_")
    found = triples.where(F.col("predicate") == wanted)
    return found.where(valid_on(F.col("valid_from"), F.col("valid_to"), F.lit(as_of))) if as_of else found


def timeline(triples: DataFrame, entity: str | None = None, n: int = 100) -> DataFrame:
    """The first n facts by start, unknown starts last."""
    found = triples
    if entity:
        wanted = entity.lower().replace(" ", "_").replace("'", "")
        found = found.where((entity_id(F.col("subject")) == wanted) | (entity_id(F.col("object")) == wanted))
    return found.orderBy(F.asc_nulls_last("valid_from"), "subject", "predicate", "object").limit(n)


def stats(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))


def entities(triples: DataFrame) -> DataFrame:
    """id and name of every subject and object; of several spellings the first by name."""
    names = triples.select(F.col("subject").alias("name")).union(triples.select("object"))
    return names.groupBy(entity_id(F.col("name")).alias("id")).agg(F.min("name").alias("name"))


def invalidate(triples: DataFrame, subject: str, predicate: str, obj: str, ended: str) -> DataFrame:
    """All triples, the open ones that match closed on that day."""
    met = (entity_id(F.col("subject")) == subject.lower().replace(" ", "_").replace("'", "")) & (F.col("predicate") == predicate) & (entity_id(F.col("object")) == obj.lower().replace(" ", "_").replace("'", ""))
    return triples.withColumn("valid_to", F.when(met & F.col("valid_to").isNull(), F.lit(ended)).otherwise(F.col("valid_to")))


def as_of_join(left: DataFrame, triples: DataFrame, day: Column) -> DataFrame:
    """left (with subject) joined with the facts of its subject that held on its day."""
    named = triples.withColumnRenamed("subject", "fact_subject")
    return left.join(named, (F.col("subject") == F.col("fact_subject")) & valid_on(F.col("valid_from"), F.col("valid_to"), day))


def _deletions(name: Column) -> Column:
    """All strings that are the name less none, one or two of its characters."""

    def less(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        return F.when(F.char_length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(name), less(name), F.flatten(F.transform(less(name), less))))


def similar_names(mentioned: DataFrame, registry: DataFrame) -> DataFrame:
    """name_a (mentioned), name_b (registered, not mentioned) and their edit distance, 1 or 2.

    Names within two edits of each other become equal when up to two characters are taken from each. So pairs meet
    on the shortened names, and not everything is compared with everything.
    """
    seen = mentioned.select("name").distinct()
    known = registry.select(F.col("name").alias("name_b")).distinct().join(seen, F.col("name_b") == F.col("name"), "left_anti")
    left = seen.select(F.col("name").alias("name_a"), F.explode(_deletions(F.lower("name"))).alias("key"))
    right = known.select("name_b", F.explode(_deletions(F.lower("name_b"))).alias("key"))
    pairs = left.join(right, "key").select("name_a", "name_b").distinct()
    return pairs.withColumn("distance", F.levenshtein(F.lower("name_a"), F.lower("name_b"))).where(F.col("distance").between(1, 2))


def mismatches(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """Claims (subject, predicate, object) whose pair has a current fact with another predicate."""
    now = triples.where("valid_to is null").select(entity_id(F.col("subject")).alias("s"), F.lower(F.trim("object")).alias("o"), F.lower("predicate").alias("fact"))
    return claims.join(now, (entity_id(claims["subject"]) == F.col("s")) & (F.lower(F.trim(claims["object"])) == F.col("o")) & (F.lower(claims["predicate"]) != F.col("fact"))).select("subject", "predicate", "object", "fact")


def stale(claims: DataFrame, triples: DataFrame, today: str) -> DataFrame:
    """Claims whose very fact has ended before today."""
    ended = triples.where(F.col("valid_to") < today).select(entity_id(F.col("subject")).alias("s"), F.lower(F.trim("object")).alias("o"), F.lower("predicate").alias("fact"), F.col("valid_to").alias("ended"))
    return claims.join(ended, (entity_id(claims["subject"]) == F.col("s")) & (F.lower(F.trim(claims["object"])) == F.col("o")) & (F.lower(claims["predicate"]) == F.col("fact"))).select("subject", "predicate", "object", "ended")
