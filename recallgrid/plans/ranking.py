"""Queries over vectors and fused ranks, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import dates, vectors as V
from recallgrid.operators import fusion, keyword, metrics, storage, vector
from recallgrid.plans.registry import query
from recallgrid.sources.tables import drawers, table, vectors

QUERY_ID = 7
Q = "q AS (SELECT v FROM vectors WHERE vec_id = 7)"
COS = "list_cosine_similarity(vectors.v, q.v)"


def _query(frame):
    """The vector that is asked for: one row."""
    return frame.where(f"vec_id = {QUERY_ID}").first()["v"]


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("knn_cosine", f"WITH [[VECTORS]], {Q} SELECT vec_id, round({COS}, 6) AS similarity FROM vectors, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf):
    v = vectors(spark, sf)
    return _round(vector.knn(v, _query(v), 10), "similarity")


@query("knn_filtered", f"WITH [[VECTORS]], {Q} SELECT vec_id, round({COS}, 6) AS similarity FROM vectors, q WHERE label = 3 ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    v = vectors(spark, sf)
    return _round(vector.knn(v.where("label = 3"), _query(v), 10), "similarity")


@query("knn_gated", f"WITH [[DRAWERS]], [[POSTINGS]], [[VECTORS]], {Q} SELECT vec_id, round({COS}, 6) AS similarity FROM vectors, q WHERE vec_id IN (SELECT chunk_index FROM drawers JOIN postings USING (drawer_id) WHERE token = 'thing') ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_gated(spark, sf):
    v = vectors(spark, sf)
    candidates = keyword.search(drawers(spark, sf), ["thing"]).select(F.col("chunk_index").alias("vec_id"))
    return _round(vector.knn(v, _query(v), 10, candidates), "similarity")


@query("knn_batch", """WITH [[VECTORS]], u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors), s AS (SELECT a.vec_id AS query, b.vec_id, list_dot_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_batch(spark, sf):
    v = vectors(spark, sf)
    return _round(vector.knn_batch(v, v.where("vec_id % 100 = 0"), 10), "similarity")


@query("check_duplicate", f"WITH [[VECTORS]], {Q}, n AS (SELECT vec_id, {COS} AS s FROM vectors, q ORDER BY s DESC, vec_id LIMIT 5) SELECT vec_id, round(s, 6) AS similarity FROM n WHERE s >= 0.9")
def check_duplicate(spark, sf):
    v = vectors(spark, sf)
    return _round(vector.duplicates(v, _query(v)), "similarity")


@query("matryoshka_knn", f"WITH vectors AS (SELECT vec_id, embedding[:16]::DOUBLE[] AS v FROM embeddings), {Q} SELECT vec_id, round({COS}, 6) AS similarity FROM vectors, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def matryoshka_knn(spark, sf):
    v = vectors(spark, sf).withColumn("v", V.truncate(F.col("v"), 16))
    return _round(vector.knn(v, _query(v), 10), "similarity")


CENTROIDS = "means AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors) GROUP BY label, dim) GROUP BY label)"


@query("centroid", f"WITH [[VECTORS]], {CENTROIDS} SELECT label, dim, round(x, 6) AS x FROM (SELECT label, unnest(c) AS x, generate_subscripts(c, 1)::INT - 1 AS dim FROM means)")
def centroid(spark, sf):
    return _round(vector.centroids(vectors(spark, sf)).select("label", F.posexplode("v").alias("dim", "x")), "x")


REPRESENTATIVES = f"{CENTROIDS}, best AS (SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(v, c) DESC, vec_id) AS rank FROM vectors JOIN means USING (label)) WHERE rank <= 10)"


@query("aggregate_topk", f"WITH [[VECTORS]], {REPRESENTATIVES} SELECT 'room' AS level, label AS container, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS members, any_value(n) AS member_count FROM best JOIN (SELECT label, count(*) AS n FROM vectors GROUP BY label) USING (label) GROUP BY label")
def aggregate_topk(spark, sf):
    found = vector.aggregates(vectors(spark, sf), "room")
    return found.select("level", "container", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("members"), "member_count")


DIMS = (64, 32, 16)
LISTS = (
    "lists AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT 'm{n}' AS model, vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, list_cosine_similarity(vectors.v[:{n}], q.v[:{n}]) AS s FROM vectors, q)" for n in DIMS)
    + ") WHERE rank < 15)"
)


def _lists(spark, sf):
    """Three models: all dimensions, half and a quarter of them."""
    out = None
    for n in DIMS:
        v = vectors(spark, sf).withColumn("v", V.truncate(F.col("v"), n))
        found = vector.knn(v, _query(v), 15).withColumn("model", F.lit(f"m{n}"))
        out = found if out is None else out.union(found)
    return fusion.ranked(out)


@query("rrf_fanout", f"WITH [[VECTORS]], {Q}, {LISTS} SELECT vec_id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, string_agg(model, ',' ORDER BY model DESC) AS models FROM lists GROUP BY vec_id")
def rrf_fanout(spark, sf):
    found = fusion.rrf(_lists(spark, sf), models=[f"m{n}" for n in DIMS])
    return found.select("vec_id", F.round("rrf_score", 6).alias("rrf_score"), F.array_join("source_models", ",").alias("models"))


BOOST = f"""{REPRESENTATIVES}, tops AS (SELECT 'room' AS level, label, row_number() OVER (ORDER BY s DESC, label) - 1 AS rank FROM (SELECT label, list_cosine_similarity(c, q.v) AS s FROM means, q)),
    boosts AS (SELECT vec_id, sum(0.3 / (60 + tops.rank)) AS boost FROM tops JOIN best USING (label) WHERE tops.rank < 15 GROUP BY vec_id)"""


def _boosts(spark, sf):
    v = vectors(spark, sf)
    scores = vector.centroids(v).select(F.col("label").alias("container"), V.cosine(F.col("v"), V.literal(_query(v))).alias("score"))
    return fusion.container_boost(vector.aggregates(v, "room").join(scores, "container"))


@query("aggregate_boost", f"WITH [[VECTORS]], {Q}, {BOOST} SELECT vec_id, round(boost, 6) AS boost FROM boosts")
def aggregate_boost(spark, sf):
    return _round(_boosts(spark, sf), "boost")


@query("composite_rank", f"WITH [[VECTORS]], {Q}, {BOOST} SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, 0.9 * {COS} + coalesce(boost, 0) AS score FROM q, vectors LEFT JOIN boosts USING (vec_id)) ORDER BY score DESC, vec_id LIMIT 10")
def composite_rank(spark, sf):
    v = vectors(spark, sf)
    all_hits = v.select("vec_id", V.cosine(F.col("v"), V.literal(_query(v))).alias("similarity"))
    ranked = fusion.composite(all_hits, _boosts(spark, sf), 0.9).orderBy(F.desc("score"), "vec_id").limit(10)
    return ranked.select("vec_id", F.round("score", 6).alias("score"))


@query("rrf_weighted", f"WITH [[VECTORS]], {Q}, {LISTS}, {BOOST} SELECT vec_id, round(sum(0.5 / (60 + rank)) + coalesce(any_value(boost), 0), 6) AS score FROM lists LEFT JOIN boosts USING (vec_id) GROUP BY vec_id")
def rrf_weighted(spark, sf):
    fused = fusion.rrf(_lists(spark, sf), 0.5)
    return fused.join(_boosts(spark, sf), "vec_id", "left").select("vec_id", F.round(F.col("rrf_score") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


BM25_TERMS = ["thing", "enth", "tion"]
BM25 = """sizes AS (SELECT drawer_id, count(token) AS len FROM drawers LEFT JOIN tokens USING (drawer_id) GROUP BY drawer_id), total AS (SELECT count(*) AS n, avg(len) AS mean FROM sizes),
    tf AS (SELECT drawer_id, token, count(*) AS f FROM tokens WHERE token IN ('thing', 'enth', 'tion') GROUP BY ALL), df AS (SELECT token, count(*) AS d FROM tf GROUP BY token),
    bm25 AS (SELECT drawer_id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (token) JOIN sizes USING (drawer_id), total GROUP BY drawer_id)"""


@query("bm25", f"WITH [[DRAWERS]], [[TOKENS]], {BM25} SELECT drawer_id, round(score, 6) AS score FROM bm25")
def bm25(spark, sf):
    return _round(fusion.bm25(drawers(spark, sf), BM25_TERMS), "score")


HITS = "hits AS (SELECT drawer_id, document, room, source_file, chunk_index, filed_day, s AS similarity FROM (SELECT vec_id, {} AS s FROM vectors, q) JOIN drawers ON chunk_index = vec_id)".format(COS)


def _hits(spark, sf):
    """Drawers with the similarity of the vector of the same number."""
    v = vectors(spark, sf)
    scored = v.select(F.col("vec_id").alias("chunk_index"), V.cosine(F.col("v"), V.literal(_query(v))).alias("similarity"))
    return drawers(spark, sf).join(scored, "chunk_index")


@query("hybrid_rank", f"WITH [[DRAWERS]], [[TOKENS]], [[VECTORS]], {Q}, {BM25}, {HITS} SELECT drawer_id, round(0.6 * greatest(0, similarity) + 0.4 * coalesce(score, 0) / (SELECT max(score) FROM bm25), 6) AS hybrid FROM hits LEFT JOIN bm25 USING (drawer_id)")
def hybrid_rank(spark, sf):
    d = drawers(spark, sf)
    return fusion.hybrid(_hits(spark, sf), fusion.bm25(d, BM25_TERMS)).select("drawer_id", F.round("hybrid", 6).alias("hybrid"))


@query("keyword_overlap_fusion", f"""WITH [[DRAWERS]], [[POSTINGS]], [[VECTORS]], {Q}, {HITS}, o AS (SELECT drawer_id, count(*) / 3.0 AS share FROM postings WHERE token IN ('thing', 'enth', 'tion') GROUP BY drawer_id)
    SELECT drawer_id, round((1 - similarity) * (1 - 0.3 * coalesce(share, 0)), 6) AS distance FROM hits LEFT JOIN o USING (drawer_id)""")
def keyword_overlap_fusion(spark, sf):
    distance = fusion.overlap_fused(1 - F.col("similarity"), fusion.overlap(F.col("document"), BM25_TERMS))
    return _hits(spark, sf).select("drawer_id", F.round(distance, 6).alias("distance"))


@query("room_soft_boost", f"WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round((1 - similarity) * CASE WHEN room = 'src3' THEN 0.8 ELSE 1 END, 6) AS distance FROM hits")
def room_soft_boost(spark, sf):
    return _hits(spark, sf).select("drawer_id", F.round(fusion.soft_boost(1 - F.col("similarity"), F.col("room") == "src3"), 6).alias("distance"))


@query("temporal_boost", f"""WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round((1 - similarity) * (1 - CASE WHEN d <= 5 THEN 0.4 WHEN d >= 15 THEN 0 ELSE 0.4 * (15 - d) / 10 END), 6) AS distance FROM (SELECT *, abs(filed_day - 19850 + 14) AS d FROM hits)""")
def temporal_boost(spark, sf):
    ago = dates.days_ago(F.lit("What did we say 2 weeks ago?"))
    boost = dates.proximity_boost(F.abs(F.col("filed_day") - 19850 + ago["days"]), ago["tolerance"])
    return _hits(spark, sf).select("drawer_id", F.round((1 - F.col("similarity")) * (1 - boost), 6).alias("distance"))


@query("quoted_boost", f"WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round((1 - similarity) * (1 - 0.6 * (contains(lower(document), 'of the')::INT + contains(lower(document), 'thing')::INT) / 2), 6) AS distance FROM hits")
def quoted_boost(spark, sf):
    return _hits(spark, sf).select("drawer_id", F.round(fusion.phrase_boost(1 - F.col("similarity"), F.col("document"), ["of the", "Thing"], 0.6), 6).alias("distance"))


@query("name_boost", f"WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round((1 - similarity) * (1 - 0.4 * contains(lower(document), 'enth')::INT), 6) AS distance FROM hits")
def name_boost(spark, sf):
    return _hits(spark, sf).select("drawer_id", F.round(fusion.phrase_boost(1 - F.col("similarity"), F.col("document"), ["Enth"], 0.4), 6).alias("distance"))


@query("closet_boost", f"""WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round(similarity + CASE source_file WHEN 'src3' THEN 0.4 WHEN 'src5' THEN 0.15 ELSE 0 END, 6) AS score, CASE WHEN source_file IN ('src3', 'src5') THEN 'drawer+closet' ELSE 'drawer' END AS matched_via FROM hits""")
def closet_boost(spark, sf):
    closets = spark.createDataFrame([("src3", 0), ("src5", 2), ("src3", 4)], "source_file string, rank int")
    return fusion.closet_boost(_hits(spark, sf), closets).select("drawer_id", F.round("score", 6).alias("score"), "matched_via")


@query("max_distance", f"WITH [[DRAWERS]], [[VECTORS]], {Q}, {HITS} SELECT drawer_id, round(similarity, 6) AS similarity FROM hits WHERE 1 - similarity <= 0.8")
def max_distance(spark, sf):
    return _round(fusion.within_distance(_hits(spark, sf), 0.8).select("drawer_id", "similarity"), "similarity")


@query("neighbor_expand", """WITH n AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT a.source AS source_file, a.i AS drawer_index, md5(string_agg(b.text, chr(10) || chr(10) ORDER BY b.i)) AS digest, (SELECT count(*) FROM documents d WHERE d.source = a.source) AS total_drawers
    FROM n a JOIN n b ON a.source = b.source AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY a.source, a.i""")
def neighbor_expand(spark, sf):
    from pyspark.sql import Window

    numbered = table(spark, sf, "documents").select(F.col("source").alias("source_file"), "doc_id", F.col("text").alias("document"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("chunk_index"))
    found = fusion.neighbours(numbered, numbered)
    return found.select("source_file", "drawer_index", F.md5("text").alias("digest"), "total_drawers")


@query("hybrid_search", f"""WITH [[DRAWERS]], [[POSTINGS]], vectors AS (SELECT 'drawer_' || lang || '_' || source || '_' || substr(md5(doc_id::VARCHAR), 1, 16) AS drawer_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id), {Q},
    c AS (SELECT drawer_id FROM drawers WHERE wing = 'en' AND drawer_id IN (SELECT drawer_id FROM postings WHERE token = 'thing')),
    m AS (SELECT 'm64' AS model, drawer_id, list_cosine_similarity(vectors.v, q.v) AS s FROM vectors, q WHERE drawer_id IN (FROM c) UNION ALL SELECT 'm16', drawer_id, list_cosine_similarity(vectors.v[:16], q.v[:16]) FROM vectors, q WHERE drawer_id IN (FROM c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, drawer_id) - 1 AS rank FROM m)
    SELECT drawer_id, round(sum(1.0 / (60 + rank)), 6) AS score, round(max(s), 6) AS similarity FROM r WHERE rank < 15 GROUP BY drawer_id ORDER BY sum(1.0 / (60 + rank)) DESC, drawer_id LIMIT 5""")
def hybrid_search(spark, sf):
    from recallgrid.operators.search import hybrid_search as run

    d, v = drawers(spark, sf), vectors(spark, sf)
    named = d.select("drawer_id", F.col("chunk_index").alias("vec_id")).join(v, "vec_id")
    models = {"m64": named, "m16": named.withColumn("v", V.truncate(F.col("v"), 16))}
    asked = _query(v)
    hits = run(d, models, {"m64": asked, "m16": asked[:16]}, ["thing"], n=5, wing="en").hits
    return hits.select("drawer_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


# Metrics: a neighbour is relevant if it has the query's label.

RANKING = """u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors), s AS (SELECT a.vec_id AS query, b.vec_id, (a.label = b.label)::INT AS relevant, list_dot_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    ranking AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s),
    totals AS (SELECT query, sum(relevant) AS alls FROM s GROUP BY query),
    each AS (SELECT query, rank, relevant, k, row_number() OVER (PARTITION BY query, k ORDER BY relevant DESC, rank) AS best FROM ranking, (SELECT unnest([1, 3, 5, 10, 30, 50]) AS k) WHERE rank <= k),
    metrics AS (SELECT query, k, (sum(relevant) > 0)::INT AS recall_any, (sum(relevant) >= any_value(alls))::INT AS recall_all, CASE WHEN any_value(alls) > 0 THEN sum(relevant) / any_value(alls) ELSE 0 END AS recall,
        CASE WHEN sum(relevant) > 0 THEN sum(relevant / log2(rank + 1)) / sum(relevant / log2(best + 1)) ELSE 0 END AS ndcg FROM each JOIN totals USING (query) GROUP BY query, k)"""


def _metrics(spark, sf):
    v = vectors(spark, sf)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    asked = v.where("vec_id % 100 = 0")
    found = vector.knn_batch(v, asked, max(metrics.KS))
    marked = found.join(labels, "vec_id").join(asked.select(F.col("vec_id").alias("query"), F.col("label").alias("wanted")), "query")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    totals = asked.select(F.col("vec_id").alias("query"), "label").join(sizes, "label")
    return metrics.at_k(marked.select("query", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("relevant")), totals)


@query("recall_at_k", f"WITH [[VECTORS]], {RANKING} SELECT query, k, recall_any, recall_all, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM metrics")
def recall_at_k(spark, sf):
    return _round(_metrics(spark, sf), "recall", "ndcg")


@query("metric_summary", f"WITH [[VECTORS]], {RANKING} SELECT k, count(*) AS queries, round(avg(recall_any), 6) AS recall_any, round(avg(recall_all), 6) AS recall_all, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM metrics GROUP BY k")
def metric_summary(spark, sf):
    return _round(metrics.summary(_metrics(spark, sf)), "recall_any", "recall_all", "recall", "ndcg")


@query("metric_distribution", f"WITH [[VECTORS]], {RANKING} SELECT k, count(*) FILTER (recall >= 1) AS perfect, count(*) FILTER (recall > 0 AND recall < 1) AS partial, count(*) FILTER (recall = 0) AS zero FROM metrics GROUP BY k")
def metric_distribution(spark, sf):
    return metrics.distribution(_metrics(spark, sf))


@query("metric_rollup", "SELECT coalesce(l.quality::VARCHAR, 'all') AS quality, coalesce(l.toxic::VARCHAR, 'all') AS toxic, count(*) AS n, round(avg(n_chars), 4) AS chars FROM documents JOIN labels l USING (doc_id) GROUP BY ROLLUP (l.quality, l.toxic)")
def metric_rollup(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    found = joined.rollup("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))
    return found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("quality", "toxic")})


@query("rank_completion", "SELECT vec_id, CASE WHEN vec_id < 5 THEN vec_id + 1 ELSE 1099511627776 + vec_id END AS rank FROM embeddings")
def rank_completion(spark, sf):
    corpus = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("position"))
    return metrics.complete(corpus.where("vec_id < 5").select("vec_id", (F.col("vec_id") + 1).alias("rank")), corpus, "vec_id").select("vec_id", "rank")


@query("regressions", """WITH b AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), a AS (SELECT event_type AS metric, avg(value) * CASE event_type WHEN 'click' THEN 0.5 ELSE 1 END AS value FROM events GROUP BY 1)
    SELECT metric, round(CASE WHEN b.value = 0 THEN 0 ELSE (a.value - b.value) / b.value END, 6) AS change, metric = 'click' AS regressed FROM a JOIN b USING (metric)""")
def regressions(spark, sf):
    base = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    before = base.withColumn("higher_is_better", F.lit(True))
    return _round(metrics.regressions(before, base.withColumn("value", F.col("value") * F.when(F.col("metric") == "click", 0.5).otherwise(1.0))), "change")


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return metrics.latencies(table(spark, sf, "events"), "event_type", "value")


@query("importance_order", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN value::VARCHAR END AS DOUBLE), 3.0) AS importance FROM events")
def importance_order(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).alias("weight"))
    return rows.select("event_id", storage.importance({"weight": "weight"}).alias("importance"))
