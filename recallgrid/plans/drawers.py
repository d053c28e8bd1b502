"""Queries over drawers: keyword search, the index, status, listings, the room graph, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import graph, keyword, storage
from recallgrid.plans.registry import query
from recallgrid.sources.tables import activity, drawers, table, turns

#: Tokens of middling frequency in the test corpus.
COMMON, OTHER = "thing", "tion"
_COLUMNS = ("drawer_id", "wing", "room", "filed_day")


def _find(name, keywords, mode, condition, **limits):
    """A keyword search and its SQL: condition over the set of tokens that a drawer has among the wanted."""
    sql = f"WITH [[DRAWERS]], [[POSTINGS]] SELECT drawer_id, wing, room, filed_day FROM drawers WHERE {condition}"
    query(name, sql)(lambda spark, sf: keyword.search(drawers(spark, sf), keywords, mode, **limits).select(*_COLUMNS))


_has = "drawer_id IN (SELECT drawer_id FROM postings WHERE token = '{}')".format
_find("kw_all", [COMMON, OTHER.upper() + " "], "all", f"{_has(COMMON)} AND {_has(OTHER)}")
_find("kw_any", [COMMON, "enth", ""], "any", f"{_has(COMMON)} OR {_has('enth')}")
_find("kw_prefix", ["thin", "ere"], "prefix", "drawer_id IN (SELECT drawer_id FROM postings WHERE starts_with(token, 'thin')) AND drawer_id IN (SELECT drawer_id FROM postings WHERE starts_with(token, 'ere'))")
_find("kw_scope", [COMMON], "all", f"{_has(COMMON)} AND wing = 'en' AND room = 'src3' AND filed_day >= 19730", wing="en", room="src3", since=19730)
_find("kw_since_until", [OTHER], "all", f"{_has(OTHER)} AND filed_day BETWEEN 19800 AND 19850", since=19800, until=19850)
_find("kw_asof", [COMMON], "all", f"{_has(COMMON)} AND filed_day <= 19760", as_of=19760)
_find("kw_stopword", ["the"], "all", "false")


@query("kw_lookup", "WITH [[DRAWERS]], [[POSTINGS]] SELECT drawer_id FROM postings WHERE token IN ('thing', 'tion') GROUP BY drawer_id HAVING count(*) = 2")
def kw_lookup(spark, sf):
    return keyword.lookup(keyword.postings(drawers(spark, sf)), [COMMON, OTHER])


@query("kw_lookup_prefix", "WITH [[DRAWERS]], [[POSTINGS]] SELECT DISTINCT drawer_id FROM postings WHERE starts_with(token, 'thing')")
def kw_lookup_prefix(spark, sf):
    return keyword.lookup(keyword.postings(drawers(spark, sf)), ["thing"], "prefix")


@query("kw_only_recent", "WITH [[DRAWERS]], [[POSTINGS]], f AS (SELECT * FROM drawers WHERE drawer_id IN (SELECT drawer_id FROM postings WHERE token = 'thing') ORDER BY filed_day DESC, drawer_id LIMIT 10) SELECT drawer_id, filed_day, strftime(DATE '1970-01-01' + filed_day, '%Y-%m-%d') AS filed, row_number() OVER (ORDER BY filed_day DESC, drawer_id) AS rank FROM f")
def kw_only_recent(spark, sf):
    from pyspark.sql import Window

    from recallgrid.functions.dates import days_to_iso
    from recallgrid.operators.search import hybrid_search

    hits = hybrid_search(drawers(spark, sf), {}, None, [COMMON], n=10).hits
    return hits.select("drawer_id", "filed_day", days_to_iso(F.col("filed_day")).alias("filed"), F.row_number().over(Window.orderBy(F.desc("filed_day"), "drawer_id")).alias("rank"))


@query("postings_stats", "WITH [[DRAWERS]], [[POSTINGS]] SELECT count(*) AS postings, count(DISTINCT token) AS tokens, count(DISTINCT drawer_id) AS drawers FROM postings")
def postings_stats(spark, sf):
    return keyword.stats(keyword.postings(drawers(spark, sf)))


@query("hot_tokens", "WITH [[DRAWERS]], [[POSTINGS]] SELECT token, count(*) AS n FROM postings GROUP BY token ORDER BY n DESC, token LIMIT 50")
def hot_tokens(spark, sf):
    return keyword.hottest(keyword.postings(drawers(spark, sf)), 50)


@query("postings_bitmap", "WITH [[DRAWERS]], [[POSTINGS]] SELECT token, count(*) AS drawers FROM postings WHERE token IN ('thing', 'tion', 'enth') GROUP BY token")
def postings_bitmap(spark, sf):
    d = drawers(spark, sf)
    return keyword.bitmap_counts(keyword.postings(d), d.select("drawer_id", F.col("chunk_index").alias("n")), [COMMON, OTHER, "enth"])


@query("postings_delete", "WITH [[DRAWERS]], [[POSTINGS]] SELECT token, count(*) AS n FROM postings WHERE drawer_id NOT IN (SELECT drawer_id FROM drawers WHERE room = 'src1') GROUP BY token")
def postings_delete(spark, sf):
    d = drawers(spark, sf)
    return keyword.remove(keyword.postings(d), d.where("room = 'src1'")).groupBy("token").agg(F.count("*").alias("n"))


@query("status_rollup", "WITH [[DRAWERS]] SELECT wing, room, count(*) AS drawers FROM drawers GROUP BY ROLLUP (wing, room)")
def status_rollup(spark, sf):
    return storage.status(drawers(spark, sf))


@query("status_by_wing", "WITH [[DRAWERS]] SELECT wing, count(*) AS drawers, count(DISTINCT room) AS rooms, sum(length(document))::BIGINT AS chars FROM drawers GROUP BY wing")
def status_by_wing(spark, sf):
    return drawers(spark, sf).groupBy("wing").agg(F.count("*").alias("drawers"), F.countDistinct("room").alias("rooms"), F.sum(F.char_length("document")).alias("chars"))


@query("rooms_in_wing", "WITH [[DRAWERS]] SELECT room, count(*) AS drawers FROM drawers WHERE wing = 'de' GROUP BY room")
def rooms_in_wing(spark, sf):
    return drawers(spark, sf).where("wing = 'de'").groupBy("room").agg(F.count("*").alias("drawers"))


HALL_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(document), $${w}$$)' for w in words)} THEN 'hall_{h}'" for h, words in text.HALLS.items()) + " ELSE 'hall_general' END"


@query("taxonomy_cube", f"WITH [[DRAWERS]] SELECT wing, room, {HALL_SQL} AS hall, count(*) AS n FROM drawers GROUP BY CUBE (wing, room, hall)")
def taxonomy_cube(spark, sf):
    return drawers(spark, sf).withColumn("hall", text.first_topic(F.col("document"))).cube("wing", "room", "hall").agg(F.count("*").alias("n"))


@query("list_drawers_page", "WITH [[DRAWERS]] SELECT drawer_id, room, CASE WHEN length(document) > 200 THEN substr(document, 1, 200) || '...' ELSE document END AS preview FROM drawers WHERE wing = 'en' ORDER BY drawer_id LIMIT 20 OFFSET 40")
def list_drawers_page(spark, sf):
    return storage.page(drawers(spark, sf).where("wing = 'en'"), 20, 40).select("drawer_id", "room", "preview")


@query("drawer_ids_md5", "SELECT doc_id, 'drawer_' || lang || '_' || source || '_' || substr(md5(text), 1, 16) AS id FROM documents")
def drawer_ids_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", storage.content_id(F.col("lang"), F.col("source"), F.col("text")).alias("id"))


@query("containers_distinct", f"WITH [[DRAWERS]] SELECT DISTINCT 'wing' AS level, wing AS container FROM drawers UNION SELECT 'room', room FROM drawers UNION SELECT 'hall', {HALL_SQL} FROM drawers")
def containers_distinct(spark, sf):
    return storage.containers(drawers(spark, sf).withColumn("hall", text.first_topic(F.col("document"))))


def _sevenths(spark, sf):
    """All drawers once more, every seventh under its own id and the others under new ones."""
    return drawers(spark, sf).withColumn("drawer_id", F.when(F.col("chunk_index") % 7 == 0, F.col("drawer_id")).otherwise(F.concat(F.lit("new_"), "drawer_id")))


@query("upsert_drawers", "WITH [[DRAWERS]] SELECT drawer_id, CASE WHEN chunk_index % 7 = 0 THEN 'new' ELSE wing END AS wing FROM drawers UNION ALL SELECT 'new_' || drawer_id, 'new' FROM drawers WHERE chunk_index % 7 <> 0")
def upsert_drawers(spark, sf):
    return storage.upsert(drawers(spark, sf).select("drawer_id", "wing"), _sevenths(spark, sf).select("drawer_id", F.lit("new").alias("wing")))


@query("add_drawers", "WITH [[DRAWERS]] SELECT drawer_id, wing FROM drawers UNION ALL SELECT 'new_' || drawer_id, 'new' FROM drawers WHERE chunk_index % 7 <> 0")
def add_drawers(spark, sf):
    return storage.add(drawers(spark, sf).select("drawer_id", "wing"), _sevenths(spark, sf).select("drawer_id", F.lit("new").alias("wing")))


@query("incremental_anti", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS mtime FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def incremental_anti(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(1.0).alias("mtime"))
    known = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("gone "), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return storage.unseen(files, d.select(known.alias("path"), F.lit(1.0).alias("mtime")))


@query("repair_split", "WITH [[DRAWERS]] SELECT wing, count(*) FILTER (chunk_index IN (SELECT vec_id FROM embeddings)) AS good, count(*) FILTER (chunk_index NOT IN (SELECT vec_id FROM embeddings)) AS bad FROM drawers GROUP BY wing")
def repair_split(spark, sf):
    good, bad = storage.repair(drawers(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_index")), "chunk_index")
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).groupBy("wing").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("eav_pivot", "SELECT event_id AS id, event_type AS kind, user_id::VARCHAR AS who, NULL::VARCHAR AS none FROM events")
def eav_pivot(spark, sf):
    e = table(spark, sf, "events")
    no = F.lit(None)
    typed = [("kind", F.col("event_type"), no.cast("long")), ("who", no.cast("string"), F.col("user_id"))]
    rows = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), s.alias("string_value"), i.alias("int_value")) for k, s, i in typed])).alias("m"))
    rows = rows.select(F.col("event_id").alias("id"), "m.*", no.cast("double").alias("float_value"), no.cast("boolean").alias("bool_value"))
    return storage.pivot_metadata(rows, ["kind", "who", "none"])


@query("layer1_topk", """WITH [[DRAWERS]], t AS (SELECT *, (chunk_index % 10)::DOUBLE AS importance FROM drawers ORDER BY importance DESC, drawer_id LIMIT 15), s AS (SELECT *, trim(replace(document, chr(10), ' ')) AS flat FROM t),
    l AS (SELECT room, drawer_id, importance, '  - ' || CASE WHEN length(flat) > 200 THEN substr(flat, 1, 197) || '...' ELSE flat END || '  (' || source_file || ')' AS line FROM s),
    u AS (SELECT *, sum(length(line) + CASE WHEN n = 1 THEN length(room) + 3 ELSE 0 END) OVER (ORDER BY room, importance DESC, drawer_id) AS used FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY importance DESC, drawer_id) AS n FROM l))
    SELECT room, drawer_id, line, used::BIGINT AS used FROM u WHERE used <= 3200""")
def layer1_topk(spark, sf):
    return storage.essential(drawers(spark, sf).withColumn("importance", (F.col("chunk_index") % 10).cast("double")))


@query("recall_scope", "WITH [[DRAWERS]] SELECT drawer_id, CASE WHEN length(f) > 300 THEN substr(f, 1, 297) || '...' ELSE f END AS snippet FROM (SELECT drawer_id, replace(trim(document), chr(10), ' ') AS f FROM drawers WHERE wing = 'fr' AND room = 'src8' ORDER BY drawer_id LIMIT 10)")
def recall_scope(spark, sf):
    rows = keyword.scope(drawers(spark, sf), wing="fr", room="src8").orderBy("drawer_id").limit(10)
    return rows.select("drawer_id", text.snippet(F.col("document"), 300).alias("snippet"))


@query("diary_latest", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def diary_latest(spark, sf):
    return storage.latest(turns(spark, sf), "conv_id", "turn", 3).select("conv_id", "turn")


# The room graph. Wings and rooms of the test corpus: a room is a source, a wing a language.


def _nodes(spark, sf):
    return graph.room_nodes(drawers(spark, sf).withColumn("hall", text.first_topic(F.col("document"))))


NODES = f"""[[DRAWERS]], nodes AS (SELECT room, list_sort(list(DISTINCT wing)) AS wings, list_sort(list(DISTINCT {HALL_SQL})) AS halls, count(*) AS count, list_sort(list(DISTINCT filed_day))[-5:] AS dates
    FROM drawers WHERE room <> '' AND room <> 'general' AND wing <> '' GROUP BY room)"""
EDGES = "edges AS (SELECT room, wing_a, wing_b, hall, count FROM (SELECT room, count, unnest(halls) AS hall, wing_a, wing_b FROM (SELECT n.room, n.count, n.halls, a.wing AS wing_a, b.wing AS wing_b FROM nodes n JOIN (SELECT room, unnest(wings) AS wing FROM nodes) a USING (room) JOIN (SELECT room, unnest(wings) AS wing FROM nodes) b USING (room) WHERE a.wing < b.wing)))"


@query("room_graph_nodes", f"WITH {NODES} SELECT room, array_to_string(wings, ',') AS wings, array_to_string(halls, ',') AS halls, count, array_to_string(dates, ',') AS dates FROM nodes")
def room_graph_nodes(spark, sf):
    return _nodes(spark, sf).select("room", F.array_join("wings", ",").alias("wings"), F.array_join("halls", ",").alias("halls"), "count", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"))


@query("room_graph_edges", f"WITH {NODES}, {EDGES} SELECT * FROM edges")
def room_graph_edges(spark, sf):
    return graph.room_edges(_nodes(spark, sf))


@query("tunnels", f"WITH {NODES} SELECT room, array_to_string(wings, ',') AS wings, count, dates[-1]::VARCHAR AS recent FROM nodes WHERE len(wings) >= 2 AND list_contains(wings, 'de') AND list_contains(wings, 'fr') ORDER BY count DESC, room LIMIT 50")
def tunnels(spark, sf):
    return graph.tunnels(_nodes(spark, sf), "de", "fr").select("room", F.array_join("wings", ",").alias("wings"), "count", "recent")


@query("graph_stats", f"WITH {NODES}, {EDGES} SELECT count(*) AS total_rooms, count(*) FILTER (len(wings) >= 2) AS tunnel_rooms, (SELECT count(*) FROM edges) AS total_edges FROM nodes")
def graph_stats(spark, sf):
    nodes = _nodes(spark, sf)
    return graph.graph_stats(nodes, graph.room_edges(nodes))


@query("rooms_per_wing", f"WITH {NODES} SELECT wing, count(*) AS rooms FROM (SELECT unnest(wings) AS wing FROM nodes) GROUP BY wing")
def rooms_per_wing(spark, sf):
    return graph.rooms_per_wing(_nodes(spark, sf))




@query("traverse_bfs", """WITH RECURSIVE places AS (SELECT DISTINCT 'u' || user_id AS room, event_type || '_' || strftime(ts, '%Y-%m-%d') AS wing FROM events),
    sizes AS (SELECT 'u' || user_id AS room, count(*) AS count FROM events GROUP BY 1),
    steps AS (SELECT DISTINCT a.room AS x, b.room AS y FROM places a JOIN places b USING (wing) WHERE a.room <> b.room),
    walk AS (SELECT 'u1' AS room, 0 AS hop UNION SELECT y, hop + 1 FROM walk JOIN steps ON x = room WHERE hop < 2)
    SELECT room, min(hop) AS hop, any_value(count) AS count FROM walk JOIN sizes USING (room) GROUP BY room ORDER BY hop, count DESC, room LIMIT 50""")
def traverse_bfs(spark, sf):
    rooms = activity(spark, sf).select(F.concat(F.lit("u"), F.col("session").cast("string")).alias("room"), F.concat_ws("_", "kind", F.date_format("ts", "yyyy-MM-dd")).alias("wing"))
    return graph.walk(graph.room_nodes(rooms), "u1", 2)


@query("tunnel_symmetric_id", """WITH l AS (SELECT lang || '/' || source AS a, 'en/src' || (doc_id % 20) AS b FROM documents)
    SELECT substr(sha256(least(a, b) || '↔' || greatest(a, b)), 1, 16) AS tunnel_id, count(*) AS n FROM l GROUP BY 1""")
def tunnel_symmetric_id(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("a"), F.concat(F.lit("en/src"), (F.col("doc_id") % 20).cast("string")).alias("b"))
    return d.groupBy(graph.tunnel_id(F.col("a"), F.col("b")).alias("tunnel_id")).agg(F.count("*").alias("n"))


@query("fuzzy_rooms", f"WITH {NODES} SELECT room, CASE WHEN contains(room, '1-src') THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM nodes WHERE contains(room, '1') OR contains(room, 'src') ORDER BY score DESC, room LIMIT 5")
def fuzzy_rooms(spark, sf):
    return graph.fuzzy_rooms(_nodes(spark, sf), "1-src")


@query("source_duplicates", "WITH [[DRAWERS]] SELECT source_file, count(*) AS drawers, floor(count(*) * 0.4)::BIGINT AS estimate FROM drawers GROUP BY source_file HAVING count(*) > 20 ORDER BY drawers DESC, source_file LIMIT 15")
def source_duplicates(spark, sf):
    from recallgrid.operators.compression import duplicate_estimate

    return duplicate_estimate(drawers(spark, sf)).orderBy(F.desc("drawers"), "source_file").limit(15)


@query("update_drawers", "WITH [[DRAWERS]] SELECT drawer_id, CASE WHEN chunk_index % 7 = 0 THEN 'moved' ELSE room END AS room FROM drawers")
def update_drawers(spark, sf):
    d = drawers(spark, sf)
    return storage.update(d.select("drawer_id", "room"), d.where("chunk_index % 7 = 0").select("drawer_id", F.lit("moved").alias("room")))


@query("delete_drawers", "WITH [[DRAWERS]] SELECT drawer_id FROM drawers WHERE chunk_index % 7 <> 0")
def delete_drawers(spark, sf):
    return storage.delete(drawers(spark, sf), _sevenths(spark, sf)).select("drawer_id")


@query("search_memories", "WITH [[DRAWERS]], [[POSTINGS]] SELECT document AS text, wing, room, source_file, NULL::DOUBLE AS similarity FROM drawers WHERE wing = 'en' AND drawer_id IN (SELECT drawer_id FROM postings WHERE token = 'thing') ORDER BY filed_day DESC, drawer_id LIMIT 5")
def search_memories(spark, sf):
    from recallgrid.operators import search

    return search.memories(search.hybrid_search(drawers(spark, sf), {}, None, ["thing"], n=5, wing="en"))
