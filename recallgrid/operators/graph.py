"""The room graph, tunnels between wings, breadth-first walks, and personalised PageRank."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import entity_id

#: PageRank's fixed values.
DAMPING, ITERATIONS, TOLERANCE = 0.85, 30, 1e-6
#: Rounds after which the scores are cut off from their lineage and their change is read.
ROUNDS = 5


def room_nodes(drawers: DataFrame, hall: str | None = "hall", day: str | None = "filed_day") -> DataFrame:
    """room, wings, halls, count, dates (the last five). Rooms without a name or called general, and drawers without a wing, are left out."""
    rows = drawers.where((F.col("room") != "") & (F.col("room") != "general") & (F.col("wing") != ""))
    halls = F.sort_array(F.collect_set(F.nullif(F.col(hall), F.lit("")))) if hall in drawers.columns else F.array().cast("array<string>")
    dates = F.sort_array(F.collect_set(day)) if day in drawers.columns else F.array().cast("array<int>")
    found = rows.groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"), halls.alias("halls"), F.count("*").alias("count"), dates.alias("dates"))
    return found.withColumn("dates", F.when(F.size("dates") > 5, F.slice("dates", -5, 5)).otherwise(F.col("dates")))


def room_edges(nodes: DataFrame) -> DataFrame:
    """room, wing_a < wing_b, hall, count: a room's wings in pairs, for each of its halls."""
    first = nodes.where(F.size("wings") >= 2).select("room", "count", "halls", "wings", F.posexplode("wings").alias("i", "wing_a"))
    pairs = first.select("room", "count", "halls", "wing_a", F.explode(F.slice("wings", F.col("i") + 2, F.size("wings"))).alias("wing_b"))
    return pairs.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "count")


def tunnels(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, n: int = 50) -> DataFrame:
    """Rooms of two wings or more (with the given ones among them), the largest first."""
    found = nodes.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing:
            found = found.where(F.array_contains("wings", wing))
    return found.select("room", "wings", "halls", "count", F.coalesce(F.try_element_at("dates", F.lit(-1)).cast("string"), F.lit("")).alias("recent")).orderBy(F.desc("count"), "room").limit(n)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_rooms, tunnel_rooms, total_edges."""
    rooms = nodes.agg(F.count("*").alias("total_rooms"), F.count_if(F.size("wings") >= 2).alias("tunnel_rooms"))
    return rooms.join(F.broadcast(edges.agg(F.count("*").alias("total_edges"))))  # a row each


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def walk(nodes: DataFrame, start: str, hops: int = 2, n: int = 50) -> DataFrame:
    """room, hop, count: rooms reached from start over shared wings, nearest and largest first.

    A hop goes from rooms to their wings and back through the table of (room, wing); a room is taken at its first hop.
    Each hop is cut off from the plan of the one before, which would otherwise double with it.
    """
    places = _cut(nodes.select("room", "count", F.explode("wings").alias("wing")))
    seen = _cut(nodes.where(F.col("room") == start).select("room", F.lit(0).alias("hop")))
    frontier = seen
    for hop in range(1, max(0, min(hops, 10)) + 1):
        wings = places.join(frontier.select("room"), "room", "left_semi").select("wing").distinct()
        frontier = _cut(places.join(wings, "wing", "left_semi").select("room").distinct().join(seen.select("room"), "room", "left_anti").withColumn("hop", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen.join(places.select("room", "count").distinct(), "room").select("room", "hop", "count").orderBy("hop", F.desc("count"), "room").limit(n)


def fuzzy_rooms(nodes: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Rooms that contain the query (1.0) or one of its words between dashes (0.5)."""
    low = query.lower()
    part = F.lit(False)
    for word in low.split("-"):
        part = part | F.col("room").contains(word)
    scored = nodes.select("room", F.when(F.col("room").contains(low), 1.0).when(part, 0.5).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "room").limit(n)


def tunnel_id(a, b):
    """The same 16 hex digits for two endpoints, whichever comes first."""
    return F.substring(F.sha2(F.concat(F.least(a, b), F.lit("↔"), F.greatest(a, b)), 256), 1, 16)


def make_tunnels(links: DataFrame) -> DataFrame:
    """links (wing_a, room_a, wing_b, room_b, label) with their ids; the last label by name wins for a pair."""
    ends = [F.concat_ws("/", f"wing_{x}", f"room_{x}") for x in "ab"]
    return links.withColumn("tunnel_id", tunnel_id(*ends)).groupBy("tunnel_id").agg(*[F.max_by(c, F.struct("label", *links.columns)).alias(c) for c in links.columns])


def follow_tunnels(made: DataFrame, wing: str, room: str) -> DataFrame:
    """The other ends of a room's tunnels."""
    a = made.where((F.col("wing_a") == wing) & (F.col("room_a") == room)).select("tunnel_id", F.col("wing_b").alias("wing"), F.col("room_b").alias("room"), "label")
    b = made.where((F.col("wing_b") == wing) & (F.col("room_b") == room)).select("tunnel_id", F.col("wing_a").alias("wing"), F.col("room_a").alias("room"), "label")
    return a.union(b)


def adjacency(triples: DataFrame) -> DataFrame:
    """a, b, weight in both directions: summed confidence (.5 where 0 or unknown) of open triples; no self-loops."""
    weight = F.when(F.col("confidence").isNull() | (F.col("confidence") == 0), 0.5).otherwise(F.col("confidence"))
    ends = triples.where("valid_to is null").select(entity_id(F.col("subject")).alias("a"), entity_id(F.col("object")).alias("b"), weight.alias("w")).where("a <> '' and b <> '' and a <> b")
    return ends.union(ends.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def pagerank(edges: DataFrame, seeds: Sequence[str], damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """node, score of a walk that returns to the seeds; seeds outside the graph are dropped, and none gives no rows.

    Scores exist for reached nodes only. Every ROUNDS rounds, and after the last, the scores are checkpointed, lineage ends,
    and the L1 change of that round is read: below the tolerance the walk stops.
    """
    spark = edges.sparkSession
    edges = _cut(edges)
    out = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    steps = edges.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p"))
    steps = _cut(steps)
    valid = [r["a"] for r in out.where(F.col("a").isin(*seeds)).select("a").collect()] if seeds else []
    schema = "node string, score double"
    if not valid:
        return spark.createDataFrame([], schema)
    start = spark.createDataFrame([(s, 1.0 / len(valid)) for s in sorted(valid)], schema)
    scores = start
    for i in range(iterations):
        moved = scores.join(steps, scores["node"] == steps["a"]).select(F.col("b").alias("node"), (damping * F.col("score") * F.col("p")).alias("score"))
        after = moved.union(start.select("node", (F.col("score") * (1 - damping)).alias("score"))).groupBy("node").agg(F.sum("score").alias("score"))
        if i % ROUNDS == ROUNDS - 1 or i == iterations - 1:
            after = _cut(after)
            change = after.select("node", F.col("score").alias("now")).join(scores, "node", "full").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0]
            scores = after
            if change < tolerance:
                break
        else:
            scores = after
    return scores


def _cut(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in the folder that the session names; a new local one where all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="recallgrid-"))
    return df.checkpoint()


def pagerank_candidates(scores: DataFrame, evidence: DataFrame, top: int = 20) -> DataFrame:
    """drawer_id of the drawers behind the best entities; evidence: entity, drawer_id."""
    best = scores.orderBy(F.desc("score"), "node").limit(top)
    return evidence.join(F.broadcast(best.select(F.col("node").alias("entity"))), "entity", "left_semi").select("drawer_id").distinct()


def query_entities(text):
    """Runs of one to three capitalised words, as entity ids, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,2}"), F.lit(0)), entity_id))
