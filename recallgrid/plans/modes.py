"""Queries for the ranking modes of retrieval benchmarks, picks, made tunnels, export, and entities in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import vectors as V
from recallgrid.operators import extraction, fusion, graph, metrics, routing, storage, vector
from recallgrid.plans.ranking import BM25_TERMS, COS, HITS, Q, RANKING, _hits, _metrics, _query, _round
from recallgrid.plans.registry import query
from recallgrid.sources.tables import drawers, table, vectors

SHARES = "o AS (SELECT drawer_id, count(*) AS n FROM postings WHERE token IN ('thing', 'tion') GROUP BY drawer_id)"


@query("dialog_hybrid", f"""WITH [[DRAWERS]], [[POSTINGS]], [[VECTORS]], {Q}, {HITS}, {SHARES}
    SELECT drawer_id, round((1 - similarity) * (1 - 0.5 * coalesce(n, 0) / 2.0) * (1 - 0.6 * contains(lower(document), 'of the')::INT) * (1 - 0.2 * contains(lower(document), 'enth')::INT), 6) AS distance FROM hits LEFT JOIN o USING (drawer_id)""")
def dialog_hybrid(spark, sf):
    distance = fusion.dialog_distance(1 - F.col("similarity"), F.col("document"), BM25_TERMS, ["Enth"], ["of the"])
    return _hits(spark, sf).select("drawer_id", F.round(distance, 6).alias("distance"))


@query("predicate_overlap", f"""WITH [[DRAWERS]], [[POSTINGS]], [[VECTORS]], {Q}, {HITS}, {SHARES}
    SELECT drawer_id, round((1 - similarity) * (1 - 0.5 * coalesce(n, 0) / 2.0), 6) AS distance FROM hits LEFT JOIN o USING (drawer_id)""")
def predicate_overlap(spark, sf):
    distance = fusion.dialog_distance(1 - F.col("similarity"), F.col("document"), BM25_TERMS, ["Enth"], weights=(0.5, 0.0, 0.0))
    return _hits(spark, sf).select("drawer_id", F.round(distance, 6).alias("distance"))


@query("two_pass", f"""WITH [[VECTORS]], {Q}, asked AS (SELECT vec_id FROM vectors, q ORDER BY list_cosine_similarity(vectors.v[:16], q.v[:16]) DESC, vec_id LIMIT 5),
    again AS (SELECT vec_id, row_number() OVER (ORDER BY {COS} DESC, vec_id) AS rank FROM vectors, q WHERE vec_id IN (FROM asked))
    SELECT vec_id, coalesce(rank, 1099511627776 + vec_id) AS rank FROM vectors LEFT JOIN again USING (vec_id)""")
def two_pass(spark, sf):
    v = vectors(spark, sf)
    asked, corpus = v.withColumn("v", V.truncate(F.col("v"), 16)), v.select("vec_id", F.col("vec_id").alias("position"))
    return routing.two_pass(asked, v, _query(v)[:16], corpus, whole_query=_query(v)).select("vec_id", "rank")


@query("hall_navigation", f"""WITH [[VECTORS]], {Q}, d AS (SELECT vec_id, label, 1 - {COS} AS d FROM vectors, q), near AS (SELECT vec_id FROM d WHERE label = 3 ORDER BY d, vec_id LIMIT 10)
    SELECT vec_id, round(d * CASE label WHEN 3 THEN 0.75 WHEN 5 THEN 0.9 ELSE 1 END * CASE WHEN vec_id IN (FROM near) THEN 0.85 ELSE 1 END, 6) AS distance FROM d""")
def hall_navigation(spark, sf):
    v = vectors(spark, sf)
    halls = v.withColumn("hall", F.concat(F.lit("hall_"), F.col("label").cast("string")))
    return _round(routing.hall_navigation(halls, _query(v), ["hall_3", "hall_5"]), "distance")


@query("diary_layer", f"""WITH [[VECTORS]], {Q}, own AS (SELECT label, 1 - {COS} AS d FROM vectors, q), diary AS (SELECT label, 0.8 * (1 - list_cosine_similarity(vectors.v[:16], q.v[:16])) AS d FROM vectors, q)
    SELECT label, round(min(d), 6) AS distance FROM (FROM own UNION ALL FROM diary) GROUP BY label""")
def diary_layer(spark, sf):
    v = vectors(spark, sf)
    q = _query(v)
    far = lambda df, x: df.select("label", (1 - V.cosine(F.col("v"), V.literal(x))).alias("distance"))
    return _round(routing.with_layer(far(v, q), far(v.withColumn("v", V.truncate(F.col("v"), 16)), q[:16]), "label"), "distance")


@query("promote_pick", f"WITH [[VECTORS]], {Q}, r AS (SELECT vec_id, row_number() OVER (ORDER BY {COS} DESC, vec_id) AS rank FROM vectors, q) SELECT vec_id, CASE WHEN rank = 6 THEN 1 WHEN rank < 6 THEN rank + 1 ELSE rank END::BIGINT AS rank FROM r WHERE rank <= 50")
def promote_pick(spark, sf):
    v = vectors(spark, sf)
    near = vector.knn(v, _query(v), 50)
    ranking = fusion.ranked(near.withColumn("model", F.lit("m"))).select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"))
    pick = ranking.where("rank = 6").first()["vec_id"]
    return routing.promote(ranking, pick, "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"))


@query("best_rooms", """WITH [[DRAWERS]], [[POSTINGS]], s AS (SELECT room, count(DISTINCT token) FILTER (token IN ('thing', 'enth', 'tion')) AS n FROM drawers LEFT JOIN postings USING (drawer_id) GROUP BY room)
    SELECT room FROM (SELECT room, n, row_number() OVER (ORDER BY n DESC, room) AS place, max(n) OVER () AS top FROM s) WHERE place <= 4 OR top = 0""")
def best_rooms(spark, sf):
    return routing.best_rooms(drawers(spark, sf), BM25_TERMS, 4, text="document")


WORDS_SQL = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}'))"


@query("entity_metadata", f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM documents), c AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS place FROM w GROUP BY doc_id, w HAVING count(*) >= 2)
    SELECT doc_id, coalesce(string_agg(w, ';' ORDER BY w) FILTER (place <= 25), '') AS entities FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def entity_metadata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", routing.entity_metadata(F.col("text")).alias("entities"))


@query("entity_candidates", r"SELECT name, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS name FROM documents) WHERE regexp_full_match(name, '[A-Z][a-z]+') GROUP BY name HAVING count(*) >= 3")
def entity_candidates(spark, sf):
    return extraction.entity_candidates(table(spark, sf, "documents"), "text")


MADE = "made AS (SELECT substr(sha256(least(a, b) || '↔' || greatest(a, b)), 1, 16) AS tunnel_id, wing_a, room_a, wing_b, room_b FROM (SELECT DISTINCT lang AS wing_a, source AS room_a, 'en' AS wing_b, 'src1' AS room_b, lang || '/' || source AS a, 'en/src1' AS b FROM documents))"


@query("tunnels_made", f"WITH {MADE} SELECT tunnel_id, wing_b AS wing, room_b AS room FROM made WHERE wing_a = 'fr' AND room_a = 'src2' UNION ALL SELECT tunnel_id, wing_a, room_a FROM made WHERE wing_b = 'fr' AND room_b = 'src2'")
def tunnels_made(spark, sf):
    return graph.follow_tunnels(_made(spark, sf), "fr", "src2").select("tunnel_id", "wing", "room")


@query("tunnels_into", f"WITH {MADE} SELECT tunnel_id, wing_b AS wing, room_b AS room FROM made WHERE wing_a = 'en' AND room_a = 'src1' UNION ALL SELECT tunnel_id, wing_a, room_a FROM made WHERE wing_b = 'en' AND room_b = 'src1'")
def tunnels_into(spark, sf):
    return graph.follow_tunnels(_made(spark, sf), "en", "src1").select("tunnel_id", "wing", "room")


def _made(spark, sf):
    """A tunnel from each room to one room; each is made as often as the room has drawers."""
    d = drawers(spark, sf)
    return graph.make_tunnels(d.select(F.col("wing").alias("wing_a"), F.col("room").alias("room_a"), F.lit("en").alias("wing_b"), F.lit("src1").alias("room_b"), F.lit("see").alias("label")))


@query("export_index", r"SELECT lang AS wing, source AS room, count(*) AS drawers, '| ' || lang || ' | [' || source || '](wing=' || lang || '/room=' || source || ') | ' || count(*) || ' |' AS line FROM documents GROUP BY lang, source")
def export_index(spark, sf):
    return storage.export_index(drawers(spark, sf))


@query("metrics_by_type", f"""WITH [[VECTORS]], {RANKING}, t AS (SELECT m.*, l.label AS type FROM metrics m JOIN vectors l ON l.vec_id = m.query)
    SELECT k, coalesce(type::VARCHAR, 'all') AS type, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM t GROUP BY ROLLUP (k, type) HAVING k IS NOT NULL""")
def metrics_by_type(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("type"))
    found = metrics.summary(_metrics(spark, sf).join(labels, "query"), "type")
    return _round(found, "recall", "ndcg").select("k", F.coalesce(F.col("type").cast("string"), F.lit("all")).alias("type"), "queries", "recall", "ndcg")
