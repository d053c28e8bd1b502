"""Queries over the knowledge graph, streams' batch twins, and JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions.text import entity_id
from recallgrid.operators import graph, knowledge
from recallgrid.plans.registry import query
from recallgrid.sources.tables import activity, table, triples, turns
from recallgrid.streaming import incremental

NORM = "replace(replace(lower({}), ' ', '_'), '''', '')".format


@query("kg_merge_confidence", """WITH c AS (SELECT l_suppkey, l_partkey, l_discount AS c, 'o' || l_orderkey AS src FROM lineitem)
    SELECT l_suppkey AS subject, 'supplies' AS predicate, l_partkey AS object, round(CASE WHEN count(*) = 1 THEN max(c) ELSE 1 - product(1 - CASE WHEN c = 0 THEN 0.5 ELSE least(c, 0.99) END) END, 10) AS confidence,
    count(*) AS n, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM c GROUP BY l_suppkey, l_partkey""")
def kg_merge_confidence(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.col("l_partkey").alias("object"), F.col("l_discount").alias("confidence"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"))
    return knowledge.merge(rows).select("subject", "predicate", "object", F.round("confidence", 10).alias("confidence"), "n", F.array_join("sources", ",").alias("sources"))


_FACT = "predicate, subject, object, valid_from, valid_to, valid_to IS NULL AS current"


@query("kg_entity_out", f"WITH [[TRIPLES]] SELECT 'out' AS direction, {_FACT} FROM triples WHERE {NORM('subject')} = 'customer#000000007'")
def kg_entity_out(spark, sf):
    return knowledge.facts(triples(spark, sf), "Customer#000000007")


@query("kg_entity_both", f"WITH [[TRIPLES]] SELECT 'out' AS direction, {_FACT} FROM triples WHERE {NORM('subject')} = 'nation_7' UNION ALL SELECT 'in', {_FACT} FROM triples WHERE {NORM('object')} = 'nation_7'")
def kg_entity_both(spark, sf):
    return knowledge.facts(triples(spark, sf), "NATION_7", "both")


@query("kg_entity_asof", f"WITH [[TRIPLES]] SELECT 'out' AS direction, {_FACT} FROM triples WHERE {NORM('subject')} = 'customer#000000007' AND coalesce(valid_from <= '1996-06', true) AND coalesce(valid_to >= '1996-06', true)")
def kg_entity_asof(spark, sf):
    return knowledge.facts(triples(spark, sf), "customer#000000007", "out", "1996-06")


@query("kg_relationship", "WITH [[TRIPLES]] SELECT subject, object, valid_from, valid_to FROM triples WHERE predicate = 'ordered' AND coalesce(valid_from <= '1995-03-01', true) AND coalesce(valid_to >= '1995-03-01', true)")
def kg_relationship(spark, sf):
    return knowledge.relationship(triples(spark, sf), "Ordered", "1995-03-01").select("subject", "object", "valid_from", "valid_to")


@query("kg_timeline", "WITH [[TRIPLES]] SELECT subject, predicate, object, valid_from, valid_to FROM triples ORDER BY valid_from NULLS LAST, subject, predicate, object LIMIT 100")
def kg_timeline(spark, sf):
    return knowledge.timeline(triples(spark, sf)).drop("confidence")


@query("kg_stats", "WITH [[TRIPLES]] SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current, count(*) FILTER (valid_to IS NOT NULL) AS expired, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM triples")
def kg_stats(spark, sf):
    return knowledge.stats(triples(spark, sf))


@query("kg_entities", f"WITH [[TRIPLES]], n AS (SELECT subject AS name FROM triples UNION ALL SELECT object FROM triples) SELECT {NORM('name')} AS id, min(name) AS name FROM n GROUP BY 1")
def kg_entities(spark, sf):
    return knowledge.entities(triples(spark, sf))


@query("kg_invalidate", f"WITH [[TRIPLES]] SELECT subject, object, CASE WHEN {NORM('subject')} = 'nation_7' AND valid_to IS NULL THEN '2024-01-01' ELSE valid_to END AS valid_to FROM triples WHERE predicate = 'part_of'")
def kg_invalidate(spark, sf):
    region = triples(spark, sf).where("predicate = 'part_of'")
    return knowledge.invalidate(region, "Nation 7", "part_of", "ASIA", "2024-01-01").select("subject", "object", "valid_to")


@query("kg_asof_join", """WITH [[TRIPLES]], d AS (SELECT c_name AS subject, strftime(DATE '1995-01-01' + (c_custkey % 700)::INT, '%Y-%m-%d') AS day FROM customer)
    SELECT d.subject, day, predicate, object FROM d JOIN triples t ON d.subject = t.subject AND coalesce(valid_from <= day, true) AND coalesce(valid_to >= day, true) WHERE predicate = 'ordered'""")
def kg_asof_join(spark, sf):
    days = table(spark, sf, "customer").select(F.col("c_name").alias("subject"), F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")), "yyyy-MM-dd").alias("day"))
    return knowledge.as_of_join(days, triples(spark, sf).where("predicate = 'ordered'"), F.col("day")).select("subject", "day", "predicate", "object")


@query("name_typos", """WITH m AS (SELECT c_name AS name FROM customer WHERE c_custkey % 100 = 0), k AS (SELECT c_name AS name FROM customer WHERE c_custkey % 100 <> 0)
    SELECT m.name AS name_a, k.name AS name_b, levenshtein(lower(m.name), lower(k.name))::INT AS distance FROM m, k WHERE levenshtein(lower(m.name), lower(k.name)) BETWEEN 1 AND 2""")
def name_typos(spark, sf):
    """A search: the names whose id is divisible by 100 against all names."""
    names = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return knowledge.similar_names(names.where("c_custkey % 100 = 0").select("name"), names.select("name"))


CLAIMS = "claims AS (SELECT c_name AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'Located_In' ELSE 'works_in' END AS predicate, ' ' || lower(n_name) AS object FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _claims(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_name").alias("subject"), F.when(F.col("c_custkey") % 3 == 0, "Located_In").otherwise("works_in").alias("predicate"), F.concat(F.lit(" "), F.lower("n_name")).alias("object"))


@query("fact_mismatch", f"WITH [[TRIPLES]], {CLAIMS} SELECT c.subject, c.predicate, c.object, t.predicate AS fact FROM claims c JOIN triples t ON {NORM('c.subject')} = {NORM('t.subject')} AND lower(trim(t.object)) = lower(trim(c.object)) AND lower(c.predicate) <> t.predicate WHERE t.valid_to IS NULL")
def fact_mismatch(spark, sf):
    return knowledge.mismatches(_claims(spark, sf), triples(spark, sf))


@query("fact_stale", """WITH [[TRIPLES]] SELECT c_name AS subject, 'ordered' AS predicate, 'order ' || o_orderkey AS object, valid_to AS ended FROM customer JOIN orders ON o_custkey = c_custkey JOIN triples t ON t.subject = c_name AND t.object = 'Order ' || o_orderkey
    WHERE valid_to < '1996-01-01'""")
def fact_stale(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    said = joined.select(F.col("c_name").alias("subject"), F.lit("ordered").alias("predicate"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("object"))
    return knowledge.stale(said, triples(spark, sf), "1996-01-01")


ADJACENCY = f"""ends AS (SELECT {NORM('subject')} AS a, {NORM('object')} AS b, confidence AS w FROM triples WHERE valid_to IS NULL),
    adjacency AS (SELECT a, b, sum(w) AS weight FROM (SELECT * FROM ends UNION ALL SELECT b, a, w FROM ends) WHERE a <> b GROUP BY a, b)"""


@query("ppr_adjacency", f"WITH [[TRIPLES]], {ADJACENCY} SELECT * FROM adjacency")
def ppr_adjacency(spark, sf):
    return graph.adjacency(triples(spark, sf))


_STEPS = ", ".join(
    f"s{i} AS (SELECT node, sum(score) AS score FROM (SELECT b AS node, 0.85 * score * p AS score FROM s{i - 1} JOIN p ON node = a UNION ALL SELECT 'nation_7', 0.15) GROUP BY node)" for i in range(1, 5)
)


@query("ppr_scores", f"WITH [[TRIPLES]], {ADJACENCY}, p AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS p FROM adjacency), s0 AS (SELECT 'nation_7' AS node, 1.0::DOUBLE AS score), {_STEPS} SELECT node, round(score, 9) AS score FROM s4")
def ppr_scores(spark, sf):
    return graph.pagerank(graph.adjacency(triples(spark, sf)), ["nation_7", "nowhere"], iterations=4, tolerance=0).select("node", F.round("score", 9).alias("score"))


@query("ppr_candidates")
def ppr_candidates(spark, sf):
    found = triples(spark, sf)
    ends = F.explode(F.array(entity_id(F.col("subject")), entity_id(F.col("object"))))
    evidence = found.where("valid_to IS NULL").select(ends.alias("entity"), F.concat(F.lit("drawer_"), F.col("object")).alias("drawer_id"))
    return graph.pagerank_candidates(graph.pagerank(graph.adjacency(found), ["nation_7"]), evidence)


# Activity: what the streams compute, over all of it at once.


@query("session_save_counter", "SELECT conv_id, turn, (n // 2)::BIGINT AS batch FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n % 2 = 0")
def session_save_counter(spark, sf):
    return incremental.save_points(turns(spark, sf), 2)


@query("tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type AS kind, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return _rounded(incremental.tumbling(activity(spark, sf)))


@query("sliding", """WITH w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), s AS (SELECT h AS start, * FROM w UNION ALL SELECT h - INTERVAL 1 HOUR, * FROM w)
    SELECT start, start + INTERVAL 2 HOUR AS "end", event_type AS kind, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def sliding(spark, sf):
    return _rounded(incremental.sliding(activity(spark, sf)))


@query("session_windows", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS begins FROM events),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id AS session, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, n""")
def session_windows(spark, sf):
    return _rounded(incremental.session_windows(activity(spark, sf), "2 hours"))


def _rounded(windows):
    return windows.withColumn("total", F.round("total", 4)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("dirty_containers", "WITH d AS (SELECT 'user ' || user_id AS container, count(*) AS changes FROM events WHERE value > 50 GROUP BY 1) SELECT * FROM d WHERE (SELECT count(*) FROM d) >= 20")
def dirty_containers(spark, sf):
    changes = activity(spark, sf).where("value > 50").select(F.concat(F.lit("user "), F.col("session").cast("string")).alias("container"))
    return incremental.due(incremental.dirty_containers(changes))


@query("diary_news", "SELECT conv_id::VARCHAR AS path, turn AS entry FROM conversations WHERE turn >= CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END")
def diary_news(spark, sf):
    rows = turns(spark, sf).select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("entry"))
    even = F.col("path").cast("long") % 2 == 0
    done = rows.select(F.when(even, F.col("path")).otherwise(F.concat(F.lit("gone "), "path")).alias("path")).distinct().withColumn("entry_count", F.lit(2))
    return incremental.diary_news(rows, done)
