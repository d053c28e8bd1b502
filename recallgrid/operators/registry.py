"""People and projects that are known by name: canonical names, aliases, names that are also common words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that are also everyday words, and words that look like names at the start of a sentence.
EVERYDAY = (
    "ever grace will bill mark april may june joy hope faith chance chase hunter dash flash star sky river brook lane art clay gil nat max rex ray jay rose violet lily ivy ash reed sage "
    "monday tuesday wednesday thursday friday saturday sunday january february march july august september october november december"
).split()


def entities(people: DataFrame, aliases: DataFrame | None = None, everyday: Sequence[str] = EVERYDAY) -> DataFrame:
    """name, canonical, aliases, contexts, relationship, confidence, ambiguous: a row for each person and each alias.

    people: name, relationship, context; an empty or null name is left out, of several rows of one name the contexts join and the
    first relationship by name counts. aliases: alias, name; an alias of nobody in people is left out. A name is
    ambiguous if it is an everyday word, whatever its case.
    """
    named = people.withColumn("name", F.trim("name")).where("name <> ''")
    one = named.groupBy("name").agg(F.sort_array(F.collect_set(F.coalesce("context", F.lit("personal")))).alias("contexts"), F.coalesce(F.min("relationship"), F.lit("")).alias("relationship"))
    if aliases is None:
        out = one.select("name", F.col("name").alias("canonical"), F.array().cast("array<string>").alias("aliases"), "contexts", "relationship")
    else:
        own = aliases.groupBy("name").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
        out = one.join(own, "name", "left").select("name", F.col("name").alias("canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "contexts", "relationship")
        out = out.union(aliases.join(one, "name").select(F.col("alias"), "name", F.array("name"), "contexts", "relationship"))
    return out.withColumn("confidence", F.lit(1.0)).withColumn("ambiguous", F.lower("name").isin(*everyday))


def resolve(mentions: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """mentions with canonical (null if unknown) and ambiguous, by name or alias in any case."""
    own = known.groupBy(F.lower("name").alias("__name")).agg(F.min("canonical").alias("canonical"), F.max("ambiguous").alias("ambiguous"))
    return mentions.join(own, F.lower(name_col) == F.col("__name"), "left").drop("__name")


def protected_names(known: DataFrame) -> DataFrame:
    """name, in lower case: what a spelling corrector must leave alone."""
    return known.select(F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("name")).select(F.lower("name").alias("name")).distinct()
