"""Queries over texts: scalar functions, classification, chunks, closets, extraction, compression, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import dates, text
from recallgrid.operators import chunking, compression, dialect, extraction, metrics, models, registry, routing, storage
from recallgrid.plans.drawers import HALL_SQL
from recallgrid.plans.registry import query
from recallgrid.sources.tables import drawers, table, turns, vectors

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("token_estimate", f"SELECT doc_id, greatest(1, floor(len({WORDS}) * 13 / 10.0))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("compression_ratio", f"SELECT lang, sum(greatest(1, floor(len({WORDS}) * 13 / 10.0)))::BIGINT AS tokens, sum(least(200, length(text)))::BIGINT AS shown, round(sum(length(text)) / sum(least(200, length(text))), 4) AS ratio FROM documents GROUP BY lang")
def compression_ratio(spark, sf):
    size, cut = F.char_length("text"), F.least(F.lit(200), F.char_length("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"), F.sum(cut).alias("shown"), F.round(F.sum(size) / F.sum(cut), 4).alias("ratio"))


@query("sentence_split", "SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\\n]+'))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id")
def sentence_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.char_length("s")).cast("long").alias("longest"))


@query("snippet_preview", "SELECT conv_id, turn, CASE WHEN length(f) > 200 THEN substr(f, 1, 197) || '...' ELSE f END AS snippet, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM (SELECT *, replace(trim(text), chr(10), ' ') AS f FROM conversations)")
def snippet_preview(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", text.snippet(F.col("text")).alias("snippet"), text.preview(F.col("text")).alias("preview"))


@query("names_and_slugs", """SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe, replace(replace(lower(p_name), ' ', '_'), '''', '') AS entity,
    length(p_brand) <= 128 AND regexp_full_match(p_brand, '[A-Za-z0-9](?:[A-Za-z0-9_ .''-]*[A-Za-z0-9])?') AND NOT contains(p_brand, '..') AS valid FROM part""")
def names_and_slugs(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), text.safe_name(F.col("p_type")).alias("safe"), text.entity_id(F.col("p_name")).alias("entity"), text.valid_name(F.col("p_brand")).alias("valid"))


@query("content_validity", "SELECT doc_id, trim(text) <> '' AND length(text) <= 100000 AND NOT contains(text, chr(0)) AS ok FROM documents")
def content_validity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.valid_content(F.col("text")).alias("ok"))


@query("iso_days", "SELECT o_orderkey, greatest(0, o_orderdate::DATE - DATE '1970-01-01')::INT AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso, 0 AS unknown FROM orders")
def iso_days(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    days = dates.iso_to_days(F.concat(iso, F.lit("+05:00")))
    return table(spark, sf, "orders").select("o_orderkey", days.alias("days"), dates.days_to_iso(days).alias("iso"), dates.iso_to_days(F.lit("some day")).alias("unknown"))


@query("json_props", "SELECT event_id, json_keys(props)::VARCHAR AS keys, json_valid(props) AS valid FROM events")
def json_props(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query("json_list_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ',' || lang ELSE source END AS sources FROM documents")
def json_list_fallback(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("source", "lang"))).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)), ",").alias("sources"))


@query("hall_classify", f"WITH [[DRAWERS]] SELECT drawer_id, {HALL_SQL} AS hall FROM drawers")
def hall_classify(spark, sf):
    return drawers(spark, sf).select("drawer_id", text.first_topic(F.col("document")).alias("hall"))


def _best_sql(topics, column, default="general"):
    scores = {t: "(" + " + ".join(f"contains({column}, $${w}$$)::INT" for w in words) + ")" for t, words in topics.items()}
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN {s} = {best} THEN '{t}'" for t, s in scores.items()) + " END"


@query("convo_room_detect", f"SELECT conv_id, turn, {_best_sql(text.TOPICS, 'lower(substr(text, 1, 3000))')} AS room FROM conversations")
def convo_room_detect(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", text.best_topic(F.col("text")).alias("room"))


@query("hall_detect_best", f"SELECT doc_id, {_best_sql(text.HALLS, 'lower(text)')} AS hall FROM documents")
def hall_detect_best(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.best_topic(F.col("text"), text.HALLS, None).alias("hall"))


#: Texts that speak of the things that the extractors look for, put in front of the made-up prose of the corpus.
SAYINGS = ("We decided to use the new API because it works.", "Alice works at Acme Corp. Bob loves chess!", "The bug was fixed, finally. I am happy and proud.", "I prefer tabs, always use spaces instead of nothing.", "Max is Alice's brother. Alice uses Postgres.", "deploy failed: error in server, nothing works")


def _said(spark, sf):
    t = turns(spark, sf)
    pick = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("conv_id") % len(SAYINGS) + 1).cast("int"))
    return t.select("conv_id", "turn", F.concat(pick, F.lit(" "), F.col("text")).alias("content"))


SAID = "said AS (SELECT conv_id, turn, [" + ", ".join("$$" + s + "$$" for s in SAYINGS) + "][conv_id % 6 + 1] || ' ' || text AS content FROM conversations)"


@query("memory_type_score", f"WITH {SAID} SELECT conv_id, turn, " + ", ".join("(" + " + ".join(f"len(regexp_extract_all(lower(content), $${p}$$))" for p in patterns) + f")::INT AS {kind}" for kind, patterns in extraction.MEMORY.items()) + " FROM said")
def memory_type_score(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", *[s.cast("int").alias(k) for k, s in extraction.memory_scores(F.col("content")).items()])


@query("memories")
def memories(spark, sf):
    return extraction.memories(_said(spark, sf))


@query("sentiment", f"""WITH {SAID}, w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')) AS w FROM said), l AS (SELECT conv_id, turn, len(list_intersect(w, {extraction.POSITIVE})) - len(list_intersect(w, {extraction.NEGATIVE})) AS lead FROM w)
    SELECT conv_id, turn, CASE WHEN lead > 0 THEN 'positive' WHEN lead < 0 THEN 'negative' ELSE 'neutral' END AS mood FROM l""")
def sentiment(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", extraction.sentiment(F.col("content")).alias("mood"))


@query("heuristic_triples")
def heuristic_triples(spark, sf):
    return extraction.facts(_said(spark, sf), "conv_id", "content", ("Alice",))


@query("entity_detect")
def entity_detect(spark, sf):
    lines = _said(spark, sf).select(F.col("conv_id").alias("key"), F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return extraction.classify_entities(extraction.entity_scores(lines, extraction.entity_candidates(_said(spark, sf), "content")))


@query("claims", r"WITH " + SAID + r""", c AS (SELECT conv_id, unnest(regexp_extract_all(content, '\b([A-Z][A-Za-z0-9_]+)\s+is\s+([A-Z][A-Za-z0-9_]+)''s\s+([A-Za-z0-9_]+)')) AS c FROM said)
    SELECT conv_id, split_part(c, ' ', 1) AS subject, lower(split_part(c, ' ', 4)) AS predicate, replace(split_part(c, ' ', 3), '''s', '') AS object FROM c""")
def claims(spark, sf):
    return extraction.claims(_said(spark, sf), "conv_id", "content")


@query("query_sanitize")
def query_sanitize(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", extraction.clean_query(F.col("content")).alias("query"))


@query("noise_and_prose")
def noise_and_prose(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", extraction.prose(extraction.without_noise(F.col("content"))).alias("prose"))


@query("chunk_chars")
def chunk_chars(spark, sf):
    return chunking.chunk_characters(drawers(spark, sf), "drawer_id")


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format


@query("chunk_paragraph", f"""WITH [[DRAWERS]], p AS (SELECT drawer_id, list_filter(list_transform(string_split(document, chr(10) || chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS own, string_split(document, chr(10)) AS lines FROM drawers),
    g AS (SELECT drawer_id, CASE WHEN len(own) <= 1 AND len(lines) > 21 THEN list_transform(range(0, (len(lines) - 1) // 25 + 1), lambda i: {STRIP("array_to_string(lines[i * 25 + 1:i * 25 + 25], chr(10))")}) ELSE own END AS parts FROM p),
    f AS (SELECT drawer_id, list_filter(parts, lambda x: length(x) > 30) AS parts FROM g)
    SELECT drawer_id, unnest(parts) AS content, (generate_subscripts(parts, 1) - 1)::INT AS chunk_index FROM f""")
def chunk_paragraph(spark, sf):
    return chunking.paragraphs(drawers(spark, sf), "drawer_id")


@query("chunk_exchange", """WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    a AS (SELECT conv_id, turn, '> ' || text AS said, CASE WHEN next_role = 'assistant' THEN array_to_string(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:8], ' ') ELSE '' END AS answer FROM t WHERE role = 'user'),
    w AS (SELECT conv_id, turn, said || CASE WHEN answer <> '' THEN chr(10) || answer ELSE '' END AS whole FROM a),
    p AS (SELECT conv_id, turn, unnest(range(0, (length(whole) - 1) // 800 + 1)) AS part, whole FROM w)
    SELECT conv_id, turn, part::INT AS part, substr(whole, part::INT * 800 + 1, 800) AS content FROM p WHERE length(trim(substr(whole, part::INT * 800 + 1, 800))) > 30""")
def chunk_exchange(spark, sf):
    return chunking.exchanges(turns(spark, sf))


@query("corpus_granularity", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS document, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id")
def corpus_granularity(spark, sf):
    rows = turns(spark, sf).where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("document"), F.size("t").cast("long").alias("turns"))


def _closets(spark, sf):
    d = drawers(spark, sf)
    lines = chunking.closet_lines(F.col("document"), F.array("drawer_id"), F.concat_ws("/", "wing", "room", "source_file"))
    return d.select("drawer_id", "source_file", lines.alias("lines"))


@query("closet_lines")
def closet_lines(spark, sf):
    return _closets(spark, sf).select("drawer_id", F.posexplode("lines").alias("n", "line"))


@query("closet_pack")
def closet_pack(spark, sf):
    packed = _closets(spark, sf).select("drawer_id", F.posexplode(chunking.pack(F.col("lines"))).alias("closet", "document"))
    return packed.withColumn("points_to", chunking.closet_drawers(F.col("document")))


@query("dialect_summary")
def dialect_summary(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", dialect.header(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.lit("notes/a.md")).alias("header"), dialect.summary(F.col("text")).alias("summary"))


@query("dialect_emotions", "SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct([x.c for x in found]), lambda c: [list_min([x.i for x in found if x.c = c])::VARCHAR, c]))[1:3], lambda p: p[2]), '+') AS codes FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {{'i': {100 + i}, 'c': '{c}'}} END" for i, (w, c) in enumerate(dialect.EMOTIONS.items())) + "], lambda x: x IS NOT NULL) AS found FROM (SELECT conv_id * 1000 + turn AS doc_id, text || [' decided', ' worried', ' love', ' x'][turn % 4 + 1] AS text FROM conversations))")
def dialect_emotions(spark, sf):
    rows = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat("text", F.element_at(F.array(*map(F.lit, (" decided", " worried", " love", " x"))), (F.col("turn") % 4 + 1).cast("int"))).alias("text"))
    return rows.select("doc_id", F.array_join(dialect.emotions(F.col("text")), "+").alias("codes"))


SETS = "sets AS (SELECT drawer_id, list_sort(list(DISTINCT token)) AS tokens FROM postings GROUP BY drawer_id), classes AS (SELECT tokens, min(drawer_id) AS id FROM sets GROUP BY tokens)"
PAIRS = f"""{SETS}, each AS (SELECT id, unnest(tokens) AS token, len(tokens) AS n FROM classes), shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM each x JOIN each y ON x.token = y.token AND x.id < y.id AND x.n >= 0.7 * y.n AND y.n >= 0.7 * x.n GROUP BY x.id, y.id),
    pairs AS (SELECT a, b, c / (na + nb - c) AS similarity FROM shared WHERE c / (na + nb - c) >= 0.7)"""


@query("jaccard_pairs", f"WITH [[DRAWERS]], [[POSTINGS]], {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def jaccard_pairs(spark, sf):
    found = compression.alike_pairs(compression.token_sets(drawers(spark, sf)))
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("jaccard_clusters", f"""WITH RECURSIVE [[DRAWERS]], [[POSTINGS]], {PAIRS}, links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    least AS (SELECT x, min(y) AS label FROM reach GROUP BY x)
    SELECT drawer_id, coalesce(label, id) AS cluster FROM (SELECT drawer_id, tokens FROM sets UNION ALL SELECT drawer_id, [] FROM drawers WHERE drawer_id NOT IN (SELECT drawer_id FROM postings)) s
    JOIN (SELECT * FROM classes UNION ALL SELECT [], min(drawer_id) FROM drawers WHERE drawer_id NOT IN (SELECT drawer_id FROM postings)) c ON s.tokens = c.tokens LEFT JOIN least ON x = id""")
def jaccard_clusters(spark, sf):
    return compression.clusters(compression.token_sets(drawers(spark, sf)))


@query("cluster_representative")
def cluster_representative(spark, sf):
    d = drawers(spark, sf)
    hits = d.select("drawer_id", F.col("chunk_index").alias("position"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("rrf_score"), "document")
    found = compression.representatives(hits, compression.clusters(compression.token_sets(d)))
    return found.select("drawer_id", "cluster", "cluster_size", "first")


@query("near_dup_greedy")
def near_dup_greedy(spark, sf):
    joined = drawers(spark, sf).join(vectors(spark, sf).select(F.col("vec_id").alias("chunk_index"), "v"), "chunk_index")
    return compression.without_near_duplicates(joined)


@query("novelty_budget")
def novelty_budget(spark, sf):
    t = turns(spark, sf).select(F.col("conv_id").alias("query"), F.col("turn").alias("position"), F.concat_ws("_", "conv_id", "turn").alias("drawer_id"), F.col("text").alias("document"))
    return compression.compress_answers(t, "query", mode="aggressive", budget=400)


@query("sentence_dedupe")
def sentence_dedupe(spark, sf):
    t = turns(spark, sf).select(F.col("conv_id").alias("query"), F.col("turn").alias("position"), F.concat_ws("_", "conv_id", "turn").alias("drawer_id"), F.col("text").alias("document"))
    return compression.compress_answers(t, "query", mode="sentences")


@query("exact_dups", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, sf):
    found = table(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return found.where("copies > 1")


@query("token_f1", r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9_\s]', '', 'g')), '\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(lower(regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^A-Za-z0-9_\s]', '', 'g')), '\s+'), lambda w: w <> '') AS b FROM conversations),
    x AS (SELECT conv_id, turn, unnest(a) AS w FROM t WHERE b IS NOT NULL), y AS (SELECT conv_id, turn, unnest(b) AS w FROM t WHERE b IS NOT NULL),
    c AS (SELECT conv_id, turn, sum(least(n, m)) AS common FROM (SELECT conv_id, turn, w, count(*) AS n FROM x GROUP BY ALL) JOIN (SELECT conv_id, turn, w, count(*) AS m FROM y GROUP BY ALL) USING (conv_id, turn, w) GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(2.0 * common / (len(a) + len(b)), 0), 6) AS f1 FROM t LEFT JOIN c USING (conv_id, turn) WHERE b IS NOT NULL""")
def token_f1(spark, sf):
    from pyspark.sql import Window

    rows = turns(spark, sf).withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return rows.select("conv_id", "turn", F.round(metrics.token_f1(F.col("text"), F.col("next")), 6).alias("f1"))


@query("substring_recall", "SELECT item_id, count(DISTINCT source) AS sources FROM (SELECT item_id, lower(text) AS needle FROM benchmark), (SELECT source, lower(text) AS hay FROM documents) WHERE contains(hay, needle) OR (hay <> '' AND contains(needle, hay)) GROUP BY item_id")
def substring_recall(spark, sf):
    """Items and documents of which one holds the other, whole and in lower case; an empty document holds and is held by none but empty items.

    They meet on the longest run of letters that the shorter one has whole, between other characters: the longer one has it
    whole too. What has no such run is compared with all of the other table; only such items (or the whole benchmark, if
    documents have none) are broadcast, after their size has been read.
    """
    items = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("needle"))
    d = table(spark, sf, "documents").select("source", F.lower("text").alias("hay"))

    def inner(text):
        runs = F.regexp_extract_all(text, F.lit(r"(?<=[^A-Za-z])[A-Za-z]{5,}(?=[^A-Za-z])"), F.lit(0))
        return F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]

    def words(df, text):
        return df.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{5,}"), F.lit(0)))))

    keyed, known = items.withColumn("word", inner(F.col("needle"))), d.withColumn("word", inner(F.col("hay")))
    inside, held = F.contains("hay", "needle"), (F.col("hay") != "") & F.contains("needle", "hay")
    met = keyed.join(words(d, "hay"), "word").where(inside).select("item_id", "source")
    met = met.union(words(items, "needle").join(known.where("hay <> ''"), "word").where(held).select("item_id", "source"))
    met = met.union(d.join(_small(keyed.where("word IS NULL")), inside).select("item_id", "source"))
    met = met.union(known.where("word IS NULL AND hay <> ''").join(_small(items), held).select("item_id", "source"))
    return met.groupBy("item_id").agg(F.countDistinct("source").alias("sources"))


def _small(df, most=64 << 20):
    """df, broadcast where its texts have `most` bytes at most."""
    size = df.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


@query("speaker_sessions", "SELECT conv_id, string_agg(role || ' said, \"' || text || '\"', chr(10) ORDER BY turn) AS session FROM conversations GROUP BY conv_id")
def speaker_sessions(spark, sf):
    said = F.concat(F.col("role"), F.lit(' said, "'), F.col("text"), F.lit('"'))
    rows = turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "\n").alias("session"))


@query("sentinel_filter", "WITH [[DRAWERS]] SELECT count(*) AS n FROM drawers WHERE room NOT IN ('hall_registry', '_registry', 'diary')")
def sentinel_filter(spark, sf):
    return storage.without_sentinels(drawers(spark, sf)).agg(F.count("*").alias("n"))


@query("segments", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS own FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(own) <= 1 AND len(lines) > 20 THEN list_filter(list_transform(range(0, (len(lines) - 1) // 25 + 1), lambda i: regexp_replace(array_to_string(lines[i * 25 + 1:i * 25 + 25], chr(10)), '^\s+|\s+$', '', 'g')), lambda x: x <> '') ELSE own END AS parts FROM l)
    SELECT doc_id, unnest(parts) AS content, (generate_subscripts(parts, 1) - 1)::INT AS segment FROM s""")
def segments(spark, sf):
    return chunking.segments(table(spark, sf, "documents"), "doc_id", "text")


@query("halls_hydrated", f"WITH [[DRAWERS]] SELECT drawer_id, CASE WHEN chunk_index % 3 = 0 THEN 'hall_given' ELSE {HALL_SQL} END AS hall FROM drawers")
def halls_hydrated(spark, sf):
    d = drawers(spark, sf).withColumn("hall", F.when(F.col("chunk_index") % 3 == 0, "hall_given").when(F.col("chunk_index") % 3 == 1, ""))
    return storage.with_halls(d).select("drawer_id", "hall")


@query("source_filter", "WITH [[DRAWERS]] SELECT drawer_id FROM drawers WHERE contains(source_file, 'c1')")
def source_filter(spark, sf):
    return storage.from_sources(drawers(spark, sf), "c1").select("drawer_id")


@query("registered_files", "SELECT '_reg_' || substr(sha256('file ' || doc_id), 1, 24) AS drawer_id, '[registry] file ' || doc_id AS document, '_registry' AS room FROM documents WHERE doc_id % 4 <> 0")
def registered_files(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("path"))
    stored = files.select(F.when(F.col("doc_id") % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("gone "), "path")).alias("source_file"))
    return storage.registered(files, stored, "miner", "notes").select("drawer_id", "document", "room")


@query("entity_registry", """WITH p AS (SELECT n_name AS name, r_name AS context FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT 'N' || substr(name, 8) AS alias, name FROM p WHERE name LIKE '%1%')
    SELECT name, name AS canonical, coalesce((SELECT alias FROM a WHERE a.name = p.name), '') AS aliases, context FROM p UNION ALL SELECT alias, a.name, a.name, context FROM a JOIN p ON a.name = p.name""")
def entity_registry(spark, sf):
    p = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("place").alias("relationship"), F.col("r_name").alias("context"))
    a = p.where("name LIKE '%1%'").select(F.concat(F.lit("N"), F.expr("substr(name, 8)")).alias("alias"), "name")
    return registry.entities(p, a).select("name", "canonical", F.array_join("aliases", ",").alias("aliases"), F.array_join("contexts", ",").alias("context"))


@query("model_facts", """SELECT conv_id, turn, 'Speaker ' || role AS subject, 'said_in' AS predicate, 'talk ' || conv_id AS object, CASE turn % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.25 END::DOUBLE AS confidence FROM conversations WHERE turn % 4 <> 3""")
def model_facts(spark, sf):
    fact = F.to_json(F.struct(F.concat(F.lit(" Speaker "), "role").alias("subject"), F.lit("Said in").alias("predicate"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("object"), F.when(F.col("turn") % 3 == 0, "7").when(F.col("turn") % 3 == 1, "sure").otherwise("0.25").alias("confidence")))
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n["), fact, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit("Here you are: ["), fact, F.lit(', {"subject": "", "predicate": "x"}] as asked'))).when(kind == 2, fact).otherwise("no facts")
    found = models.parse_facts(turns(spark, sf).select(F.struct("conv_id", "turn").alias("at"), raw.alias("raw")), "at")
    return found.select("at.conv_id", "at.turn", "subject", "predicate", "object", "confidence")


@query("preference_documents", "WITH u AS (SELECT conv_id, turn, 'I prefer thing ' || (turn % 5) || 'x to others. ' || text AS text FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, 'thing ' || (turn % 5) || 'x to others' AS phrase, min(turn) AS first FROM u GROUP BY ALL) SELECT conv_id, 'User has mentioned: ' || string_agg(phrase, '; ' ORDER BY first) AS document FROM p GROUP BY conv_id")
def preference_documents(spark, sf):
    t = turns(spark, sf).withColumn("text", F.concat(F.lit("I prefer thing "), (F.col("turn") % 5).cast("string"), F.lit("x to others. "), "text"))
    return routing.preference_documents(t)
