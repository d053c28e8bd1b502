"""Keeping tables of drawers: adding, replacing, deleting, listing, exporting, and what has been seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text

#: Names that mark registry rows rather than memories.
SENTINELS = ("hall_registry", "_registry", "diary")
VERSION = 2


def upsert(stored: DataFrame, new: DataFrame, key: str = "drawer_id") -> DataFrame:
    """stored with new rows in place of those of the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def add(stored: DataFrame, new: DataFrame, key: str = "drawer_id") -> DataFrame:
    """stored and those new rows whose key it lacks: adding twice changes nothing."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))


def update(stored: DataFrame, changes: DataFrame, key: str = "drawer_id") -> DataFrame:
    """stored with the columns of changes replaced; a key that isn't stored is an error."""
    if missing := changes.join(stored.select(key), key, "left_anti").limit(1).count():
        raise KeyError(f"{missing} or more rows to update aren't there")
    given = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in given])
    joined = stored.join(marked, key, "left")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in stored.columns])


def delete(stored: DataFrame, keys: DataFrame, key: str = "drawer_id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def page(drawers: DataFrame, limit: int = 20, offset: int = 0, order: str = "drawer_id") -> DataFrame:
    """A page of 1 to 100 rows with previews, in order."""
    return drawers.orderBy(order).offset(max(0, offset)).limit(min(100, max(1, limit))).withColumn("preview", text.preview(F.col("document")))


def content_id(wing: Column, room: Column, content: Column) -> Column:
    """The id of a drawer that is added by hand: the same content gets the same id."""
    from recallgrid.sources.tables import drawer_id

    return drawer_id(wing, room, content)


def unseen(files: DataFrame, stored: DataFrame, tolerance: float = 0.0, version: int | None = None) -> DataFrame:
    """files (path, mtime) that are new or changed since they were stored (path, mtime, version)."""
    known = stored if version is None else stored.where(F.col("version") >= version)
    known = known.select(F.col("path").alias("__path"), F.col("mtime").alias("__mtime"))
    same = F.abs(F.col("mtime") - F.col("__mtime")) < tolerance if tolerance else F.col("mtime") == F.col("__mtime")
    return files.join(known, (F.col("path") == F.col("__path")) & same, "left_anti")


def registered(files: DataFrame, stored: DataFrame, agent: str, wing: str) -> DataFrame:
    """A registry row for each of files (path) of which nothing is stored (source_file), so that it isn't read anew every time."""
    empty = files.select(F.col("path").alias("source_file")).distinct().join(stored.select("source_file"), "source_file", "left_anti")
    digest = F.substring(F.sha2(F.col("source_file").cast("binary"), 256), 1, 24)
    return empty.select(
        F.concat(F.lit("_reg_"), digest).alias("drawer_id"), F.concat(F.lit("[registry] "), "source_file").alias("document"), F.lit(wing).alias("wing"), F.lit("_registry").alias("room"), F.lit("hall_registry").alias("hall"),
        "source_file", F.lit(agent).alias("added_by"), F.lit("registry").alias("ingest_mode"), F.lit(VERSION).alias("version"),
    )


def with_halls(drawers: DataFrame) -> DataFrame:
    """drawers with hall filled in from the text where it is null or empty; others stay."""
    given = F.nullif(F.col("hall"), F.lit("")) if "hall" in drawers.columns else F.lit(None).cast("string")
    return drawers.withColumn("hall", F.coalesce(given, text.first_topic(F.col("document"))))


def from_sources(drawers: DataFrame, part: str) -> DataFrame:
    """Drawers whose source file's name has the part in it."""
    return drawers.where(F.col("source_file").contains(part))


def without_sentinels(drawers: DataFrame) -> DataFrame:
    return drawers.where(~F.col("room").isin(*SENTINELS))


def status(drawers: DataFrame) -> DataFrame:
    """wing, room, drawers with subtotals: null room for a wing, both null for all."""
    return drawers.rollup("wing", "room").agg(F.count("*").alias("drawers"))


def containers(drawers: DataFrame) -> DataFrame:
    """level, container: the distinct wings, rooms and halls."""
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("container")) for level in ("wing", "room", "hall") if level in drawers.columns])
    return drawers.select(F.explode(pairs).alias("c")).select("c.*").where("container is not null and container <> ''").distinct()


def pivot_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """id with a column for each key of (id, key, string_value, int_value, float_value, bool_value): the typed value as text."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    return rows.withColumn("v", value).groupBy("id").pivot("key", keys).agg(F.max("v"))


def export_markdown(drawers: DataFrame, path: str) -> None:
    """A folder of Markdown by wing and room; files are split by Spark where a room is large."""
    line = F.concat(F.lit("## "), F.col("drawer_id"), F.lit("\n\n"), text.quoted(F.col("document")), F.lit("\n"))
    rows = drawers.select(text.safe_name(F.col("wing")).alias("wing"), text.safe_name(F.col("room")).alias("room"), line.alias("value"))
    rows.write.mode("overwrite").partitionBy("wing", "room").text(path)


def export_index(drawers: DataFrame) -> DataFrame:
    """wing, room, drawers, line: the table of contents of such a folder, a Markdown row with a link for each room."""
    found = drawers.groupBy("wing", "room").agg(F.count("*").alias("drawers"))
    link = F.concat(F.lit("["), "room", F.lit("](wing="), text.safe_name(F.col("wing")), F.lit("/room="), text.safe_name(F.col("room")), F.lit(")"))
    return found.withColumn("line", F.concat(F.lit("| "), "wing", F.lit(" | "), link, F.lit(" | "), F.col("drawers").cast("string"), F.lit(" |")))


def audit(entries: DataFrame, path: str, hide: tuple[str, ...] = ("content", "document", "text")) -> None:
    """Appends (timestamp, operation, params) as JSON lines, the named parameters' values hidden."""
    shown = F.map_from_entries(F.transform(F.map_entries("params"), lambda e: F.struct(e["key"], F.when(e["key"].isin(*hide), F.concat(F.lit("[redacted "), F.char_length(e["value"]).cast("string"), F.lit(" chars]"))).otherwise(e["value"]))))
    entries.withColumn("params", shown).write.mode("append").json(path)


def repair(drawers: DataFrame, vectors: DataFrame, key: str = "drawer_id") -> tuple[DataFrame, DataFrame]:
    """Drawers that have a vector, and those that don't (to be embedded again or pruned)."""
    return drawers.join(vectors.select(key), key, "left_semi"), drawers.join(vectors.select(key), key, "left_anti")


def importance(row: dict[str, str]) -> Column:
    """The first of the given columns that is present, as a number; 3 without any or for other text."""
    return F.coalesce(F.coalesce(*[F.col(c) for c in row.values()]).try_cast("double"), F.lit(3.0))


def essential(drawers: DataFrame, n: int = 15, most: int = 3200, weight: str = "importance") -> DataFrame:
    """room, line: the n weightiest drawers by room as one-line snippets, as far as `most` characters reach."""
    top = drawers.orderBy(F.desc(weight), "drawer_id").limit(n)
    line = F.concat(F.lit("  - "), text.snippet(F.col("document")), F.lit("  ("), text.basename(F.col("source_file")), F.lit(")"))
    order = Window.orderBy("room", F.desc(weight), "drawer_id")  # n rows at most
    first = F.row_number().over(Window.partitionBy("room").orderBy(F.desc(weight), "drawer_id")) == 1
    sized = top.withColumn("line", line).withColumn("cost", F.char_length("line") + F.when(first, F.char_length("room") + 3).otherwise(0))
    return sized.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= most).select("room", "drawer_id", "line", "used")


def latest(entries: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """The last n (1 to 100) entries of each writer."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return entries.withColumn("n", F.row_number().over(w)).where(F.col("n") <= min(100, max(1, n)))
