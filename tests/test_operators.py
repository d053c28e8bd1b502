"""The operators on small made-up tables, with expectations written by hand."""

import json
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import dates, text
from recallgrid.operators import chunking, compression, dialect, extraction, fusion, graph, keyword, knowledge, metrics, models, registry, search, storage, vector
from recallgrid.sources import chats, files
from recallgrid.streaming import incremental


@pytest.fixture(scope="module")
def drawers(spark):
    rows = [
        ("kiln", "Celadon glaze wants cone ten and a slow cooling kiln", "workshop", "pottery", "glazes.txt", 0, 19010),
        ("lathe", "Oil the lathe spindle before turning walnut bowls", "workshop", "wood", "lathe.txt", 0, 19012),
        ("frost", "Rhubarb crowns survive frost under a straw mulch", "outdoors", "beds", "rhubarb.txt", 3, 19015),
        ("ferry", "The island ferry skips Sundays, walnut cake on board", "outdoors", "trips", "ferry.txt", 1, 19019),
    ]
    return spark.createDataFrame(rows, "drawer_id string, document string, wing string, room string, source_file string, chunk_index int, filed_day int")


def ids(df, col="drawer_id"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.mark.parametrize(
    ("words", "mode", "limits", "want"),
    [
        (["walnut"], "all", {}, ["ferry", "lathe"]), (["WALNUT", "Spindle"], "all", {}, ["lathe"]), (["mulch", "celadon"], "any", {}, ["frost", "kiln"]), (["mulch", "celadon"], "all", {}, []), (["rhu"], "prefix", {}, ["frost"]), (["rhu"], "any", {}, []),
        (["kiln", "\t"], "all", {}, []), (["kiln", ""], "any", {}, ["kiln"]), ([""], "prefix", {}, []), (["slow cooling"], "any", {}, []), (["before"], "all", {}, ["lathe"]), (["under", "the"], "all", {}, []),
        ([], "all", {"since": 19015}, ["ferry", "frost"]), ([], "all", {"until": 19012}, ["kiln", "lathe"]), (["walnut"], "all", {"wing": "outdoors"}, ["ferry"]), (["walnut"], "all", {"wing": "attic"}, []), (["walnut"], "any", {"as_of": 19012}, ["lathe"]),
    ],
)
def test_keywords(drawers, words, mode, limits, want):
    assert ids(keyword.search(drawers, words, mode, **limits)) == want
    if words and not limits:
        assert ids(keyword.lookup(keyword.postings(drawers), words, mode)) == want


def test_stored_index(drawers, tmp_path, spark):
    keyword.write_index(drawers, str(tmp_path / "index"), 2)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert ids(keyword.lookup(index, ["walnut"])) == ["ferry", "lathe"]
    assert keyword.stats(index).first()["drawers"] == 4
    assert ids(keyword.lookup(keyword.remove(index, drawers.where("room = 'wood'")), ["walnut"])) == ["ferry"]


def test_filters_reach_the_scan(spark, sf):
    from recallgrid.sources.tables import drawers as view

    plan = keyword.search(view(spark, sf), ["thing"], wing="en")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "Exchange" not in plan


def test_search_by_time_alone_and_by_models(spark, drawers):
    newest = search.hybrid_search(drawers, {}, None, n=2).hits.collect()
    assert [r.drawer_id for r in newest] == ["ferry", "frost"] and newest[0].similarity is None
    v = spark.createDataFrame([("kiln", [1.0, 0.0]), ("lathe", [0.9, 0.1]), ("frost", [0.0, 1.0]), ("ferry", [0.0, 0.0])], "drawer_id string, v array<double>")
    asked = {"a": [1.0, 0.0]}
    assert [r.drawer_id for r in search.hybrid_search(drawers, {"a": v}, asked, n=3).hits.collect()][:2] == ["kiln", "lathe"]
    assert ids(search.hybrid_search(drawers, {"a": v}, asked, ["mulch"]).hits) == ["frost"]
    both = search.hybrid_search(drawers, {"a": v, "b": v}, asked | {"b": [0.0, 1.0]}, n=4)
    assert ids(both.hits) == ["ferry", "frost", "kiln", "lathe"] and both.fan_out == ["a", "b"]
    assert ids(search.hybrid_search(drawers, {"a": v}, asked, graph_candidates=drawers.where("room = 'trips'")).hits) == ["ferry"]

    def broken(hits):
        raise RuntimeError("no model")

    assert search.hybrid_search(drawers, {"a": v}, asked, rerank=broken).reranked is False
    again = search.hybrid_search(drawers, {"a": v}, asked, rerank=search.lexical_rerank(["mulch"]))
    assert again.reranked and again.hits.first().drawer_id == "frost"


def test_knn_batch_is_exact(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = {}
    for x in vector.knn_batch(v, v.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(x.query, []).append((x.rank, x.vec_id))
    by = dict(rows)

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for q in (0, 20, 40, 60):
        want = sorted((-round(cos(by[q], by[i]), 9), i) for i in by if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert vector.knn_batch(v, v.limit(0), 5).count() == 0


def test_rrf_does_not_depend_on_order(spark):
    lists = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "y", 0), ("b", "z", 1)], "model string, vec_id string, rank int")
    want = {"x": 1 / 60, "y": 1 / 61 + 1 / 60, "z": 1 / 61}
    for order in ("rank", "vec_id", "model"):
        got = fusion.rrf(lists.orderBy(F.desc(order)), models=["b", "a"]).collect()
        assert {r.vec_id: pytest.approx(r.rrf_score) for r in got} == want
        assert {r.vec_id: r.source_models for r in got}["y"] == ["b", "a"]


def test_bm25_prefers_the_rare_term(spark):
    df = spark.createDataFrame([("0", "database backup nightly schedule"), ("1", "database vacuum scheduled weekly"), ("2", "database failover plan"), ("3", "garden"), ("4", None)], "drawer_id string, document string")
    got = {r.drawer_id: r.score for r in fusion.bm25(df, ["database", "vacuum"]).collect()}
    assert max(got, key=got.get) == "1" and "3" not in got


def test_closets_never_hide(spark):
    hits = spark.createDataFrame([("a", "s1", 0.9), ("b", "s2", 0.2), ("c", "s3", 0.5)], "drawer_id string, source_file string, similarity double")
    closets = spark.createDataFrame([("s2", 0), ("other", 1)], "source_file string, rank int")
    got = {r.drawer_id: (r.score, r.matched_via) for r in fusion.closet_boost(hits, closets).collect()}
    assert got["b"] == (pytest.approx(0.6), "drawer+closet") and got["a"] == (0.9, "drawer") and len(got) == 3


def test_neighbours(spark):
    df = spark.createDataFrame([("f", i, f"chunk_{i}") for i in range(5)], "source_file string, chunk_index int, document string")
    got = {r.drawer_index: r for r in fusion.neighbours(df.where("chunk_index in (0, 2)").select("source_file", "chunk_index"), df).collect()}
    assert got[2].text == "chunk_1\n\nchunk_2\n\nchunk_3" and got[2].total_drawers == 5 and got[0].text == "chunk_0\n\nchunk_1"


TRIPLES = "subject string, predicate string, object string, valid_from string, valid_to string, confidence double"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("Alice", "parent_of", "Max", "2015-04-01", None, 1.0), ("Max", "does", "swimming", "2025-01-01", None, 1.0), ("Max", "does", "chess", "2024-06-01", None, 1.0), ("Alice", "works_at", "Acme Corp", "2020-01-01", "2024-12-31", 1.0), ("Alice", "works_at", "NewCo", "2025-01-01", None, 1.0)]
    return spark.createDataFrame(rows, TRIPLES)


def test_facts_as_of(facts):
    assert {r.object for r in knowledge.facts(facts, "alice", "out", "2023-01-01").collect()} == {"Max", "Acme Corp"}
    assert {r.object for r in knowledge.facts(facts, "ALICE", as_of="2026").collect()} == {"Max", "NewCo"}
    assert knowledge.facts(facts, "Max", "both").count() == 3
    closed = knowledge.invalidate(facts, "Max", "does", "chess", "2026-01-01")
    assert closed.where("object = 'chess'").first().valid_to == "2026-01-01" and closed.where("valid_to is null").count() == 3
    stats = knowledge.stats(facts).first()
    assert (stats.triples, stats.current, stats.expired) == (5, 4, 1)
    assert [r.object for r in knowledge.timeline(facts).limit(2).collect()] == ["Max", "Acme Corp"]


def test_evidence_merges(spark):
    df = spark.createDataFrame([("a", "p", "b", 0.5, "s1"), ("a", "p", "b", 0.5, "s2"), ("c", "p", "d", 0.3, "s1"), ("e", "p", "f", 1.0, "s1"), ("e", "p", "f", 1.0, "s1"), ("g", "p", "h", None, "x"), ("g", "p", "h", 0.0, "y")], "subject string, predicate string, object string, confidence double, source string")
    got = {r.subject: r for r in knowledge.merge(df).collect()}
    assert got["a"].confidence == pytest.approx(0.75) and got["a"].sources == ["s1", "s2"]
    assert got["c"].confidence == 0.3 and got["e"].confidence == pytest.approx(0.9999) and got["g"].confidence == pytest.approx(0.75)


def test_similar_names_against_all_pairs(spark):
    r = random.Random(4)
    names = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 6))) for _ in range(40)} | {"Müller", "Muller", "Miller", ""})
    mentioned = names[::5]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(x.name_a, x.name_b): x.distance for x in knowledge.similar_names(frame(mentioned), frame(names)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b): distance(a.lower(), b.lower()) for a in mentioned for b in names if b not in mentioned}
    assert got == {k: d for k, d in want.items() if 1 <= d <= 2}


def test_claims_against_facts(spark):
    said = extraction.claims(spark.createDataFrame([(1, "Bob is Alice's brother. Carol's boss is Dan.")], "id long, document string"), "id")
    assert {(r.subject, r.predicate, r.object) for r in said.collect()} == {("Bob", "brother", "Alice"), ("Dan", "boss", "Carol")}
    known = spark.createDataFrame([("bob", "husband", "alice", None, None, 1.0), ("dan", "boss", "carol", None, "2020-01-01", 1.0)], TRIPLES)
    assert knowledge.mismatches(said, known).first().fact == "husband"
    assert knowledge.stale(said, known, "2024-01-01").first().ended == "2020-01-01"


def test_pagerank_stays_in_its_component(spark):
    rows = [("alice", "works_at", "acme"), ("alice", "uses", "postgres"), ("postgres", "runs_on", "linux"), ("acme", "uses", "postgres"), ("bob", "loves", "jazz"), ("bob", "plays", "saxophone"), ("x", "is", "x")]
    edges = graph.adjacency(spark.createDataFrame([(a, p, b, None, None, None) for a, p, b in rows], TRIPLES))
    scores = {r.node: r.score for r in graph.pagerank(edges, ["alice", "nobody"]).collect()}
    assert set(scores) == {"alice", "acme", "postgres", "linux"} and sum(scores.values()) == pytest.approx(1)
    assert graph.pagerank(edges, ["nobody"]).count() == 0 and graph.pagerank(edges, []).count() == 0
    got = {r.node: r.score for r in graph.pagerank(edges, ["alice", "nobody"], iterations=7, tolerance=0).collect()}
    out = {}
    for r in edges.collect():
        out.setdefault(r.a, []).append((r.b, r.weight))
    want = {"alice": 1.0}
    for _ in range(7):
        after = {"alice": 0.15}
        for a, score in want.items():
            for b, w in out[a]:
                after[b] = after.get(b, 0) + 0.85 * score * w / sum(x for _, x in out[a])
        want = after
    assert got == pytest.approx(want)


def test_rooms_and_tunnels(spark):
    df = spark.createDataFrame([("a", "w1", "h1", 1), ("a", "w2", "h1", 2), ("b", "w2", "", 3), ("b", "w3", None, 4), ("c", "w3", "h", 5), ("general", "w1", "h", 6), ("", "w1", "h", 7), ("z", "", "h", 7)], "room string, wing string, hall string, filed_day int")
    nodes = graph.room_nodes(df)
    assert ids(nodes, "room") == ["a", "b", "c"]
    assert [tuple(r) for r in graph.room_edges(nodes).collect()] == [("a", "w1", "w2", "h1", 2)]
    assert [(r.room, r.hop) for r in graph.walk(nodes, "a", 1).collect()] == [("a", 0), ("b", 1)]
    assert [(r.room, r.hop) for r in graph.walk(nodes, "a", 9).collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.walk(nodes, "nowhere").count() == 0
    a, b = F.lit("w1/a"), F.lit("w2/b")
    one, two = spark.range(1).select(graph.tunnel_id(a, b), graph.tunnel_id(b, a)).first()
    assert one == two and len(one) == 16
    made = graph.make_tunnels(spark.createDataFrame([("w1", "a", "w2", "b", "x"), ("w2", "b", "w1", "a", "y")], "wing_a string, room_a string, wing_b string, room_b string, label string"))
    assert made.count() == 1 and graph.follow_tunnels(made, "w1", "a").first().label == "y"
    assert spark.range(1).select(graph.query_entities(F.lit("what did Alice Smith tell Bob about Bob"))).first()[0] == ["alice_smith", "bob"]


def test_alike_drawers(spark):
    r = random.Random(6)
    vocabulary = [f"word{c}{d}" for c in "abcdefgh" for d in "abcd"]
    rows = []
    for i in range(60):
        base = r.sample(vocabulary, 12)
        rows.append((f"d{i:03d}", " ".join(base)))
        if i % 3 == 0:
            rows.append((f"e{i:03d}", " ".join(base[:-1] + [r.choice(vocabulary)])))
        if i % 5 == 0:
            rows.append((f"f{i:03d}", " ".join(reversed(base))))
    rows += [("n1", ""), ("n2", None)]
    sets = compression.token_sets(spark.createDataFrame(rows, "drawer_id string, document string"))
    own = {d: set((t or "").split()) for d, t in rows}
    alike = lambda a, b: bool(own[a] | own[b]) and len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.7
    classes = {x.drawer_id: x["class"] for x in compression.alike_classes(sets).collect()}
    assert all((classes[a] == classes[b]) == (own[a] == own[b]) for a in own for b in own)
    got = {(x.a, x.b) for x in compression.alike_pairs(sets).collect()}
    first = sorted(set(classes.values()))
    assert got == {(a, b) for a in first for b in first if a < b and alike(a, b)}
    clusters = {x.drawer_id: x.cluster for x in compression.clusters(sets).collect()}
    root = {d: d for d in own}
    for _ in own:
        root = {d: min([root[d], *(root[e] for e in own if alike(d, e) or own[d] == own[e])]) for d in own}
    assert clusters == root


def test_a_long_chain_is_one_cluster(spark):
    """Each drawer is alike only to its neighbours: labels have far to go."""
    n = 400
    rows = [(f"d{i:04d}", " ".join(f"t{k}x" for k in range(i, i + 12))) for i in range(n)]
    sets = compression.token_sets(spark.createDataFrame(rows, "drawer_id string, document string"))
    assert {r.cluster for r in compression.clusters(sets).collect()} == {"d0000"}


def _long_drawers():
    """(drawer_id, document): families of sets of 1 to 900 tokens, from the same text to ones of other sizes and tokens."""
    r = random.Random(12)
    vocabulary, rows = [f"w{i}x" for i in range(5000)], []
    for i, n in enumerate((1, 2, 3, 4, 9, 40, 63, 64, 65, 90, 127, 130, 200, 300, 500, 640, 900) * 3):
        base = r.sample(vocabulary, n)
        rows.append((f"d{i:03d}a", " ".join(base)))
        for k, share in enumerate((0, 0.1, 0.17, 0.18, 0.25, 0.31)):
            other = base[int(share * n) :] + r.sample(vocabulary, int(share * n) if k % 2 else 0)
            r.shuffle(other)
            rows.append((f"d{i:03d}{'bcdefg'[k]}", " ".join(other)))
    return rows


def _written(spark, folder, run):
    """What run() returns, and the bytes it leaves in a checkpoint folder of its own."""
    sc = spark.sparkContext
    before = sc._jsc.sc().getCheckpointDir()
    sc.setCheckpointDir(f"file://{folder}")
    try:
        return run(), sum(f.stat().st_size for f in folder.rglob("part-*"))
    finally:
        sc.setCheckpointDir(before.get() if before.isDefined() else "file://" + tempfile.mkdtemp())


def test_alike_pairs_of_all_sizes_leave_little_on_disk(spark, tmp_path):
    rows = _long_drawers()
    sets = compression.token_sets(spark.createDataFrame(rows, "drawer_id string, document string"))
    got, size = _written(spark, tmp_path, lambda: compression.alike_pairs(sets).collect())
    first = {}
    for d, t in sorted(rows):
        first.setdefault(frozenset(t.split()), d)
    want = {(a, b): len(s & t) / len(s | t) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) >= 0.7 * len(s | t)}
    assert len(want) > 300 and len(got) == len(want)
    assert {(x.a, x.b): x.similarity for x in got} == want
    assert size < sum(len(t) for _, t in rows) / 4


def test_a_large_family_is_tested_in_several_places(spark):
    """Every two of 330 near copies are a pair, tested on sets that go to a place once; clusters get by with a few."""
    from recallgrid.operators import alike

    base = [f"w{i}x" for i in range(40)]
    rows = [(f"d{i:03d}", " ".join([*base, f"own{i}"])) for i in range(330)]
    sets = compression.token_sets(spark.createDataFrame(rows, "drawer_id string, document string"))
    assert compression.alike_pairs(sets).select("a", "b").distinct().count() == 330 * 329 // 2 == compression.alike_pairs(sets).count()
    assert alike.pairs(sets, alike.members(sets), 0.7, spanning=True).count() < 330 * 16
    assert {r.cluster for r in compression.clusters(sets).collect()} == {"d000"}


def test_clusters_leave_little_on_disk(spark, tmp_path):
    rows = _long_drawers()
    sets = compression.token_sets(spark.createDataFrame(rows, "drawer_id string, document string"))
    got, size = _written(spark, tmp_path, lambda: compression.clusters(sets).collect())
    assert len(got) == len(rows)
    assert {x.cluster for x in got if x.drawer_id.startswith("d016") and x.drawer_id[-1] in "abcd"} == {"d016a"}
    assert size < sum(len(t) for _, t in rows)


def test_representatives_join_without_documents(spark):
    hits = spark.createDataFrame([("a", 0, 0.5, None, "long text"), ("b", 1, 0.5, None, "longer text")], "drawer_id string, position int, similarity double, rrf_score double, document string")
    found = compression.representatives(hits, spark.createDataFrame([("a", "a"), ("b", "a")], "drawer_id string, cluster string"))
    assert [(x.drawer_id, x.document, x.cluster_size, x["first"]) for x in found.collect()] == [("b", "longer text", 2, 0)]
    plan = found.select("drawer_id", "cluster", "cluster_size", "first")._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Join"):
        plan = plan.children().head()
    assert "document" not in {plan.output().apply(i).name() for i in range(plan.output().size())}


def test_answers_are_compressed():
    hits = pd.DataFrame({"position": [0, 1, 2, 3], "document": ["The cat sat quietly. A dog barked loudly", "Cat sat quietly! Birds flew south early", "A dog barked loudly", ""]})
    got = compression.compress(hits, "sentences")
    assert got["document"].tolist() == ["The cat sat quietly. A dog barked loudly", "Birds flew south early", ""]
    short = compression.compress(hits, "aggressive", budget=10)
    assert short["document"].tolist() == ["The cat sat quietly. A dog barked loudly"]
    assert len(compression.compress(hits, "none")) == 4


def test_greedy_near_duplicates(spark):
    rows = [("s", "a", "x" * 50, [1.0, 0.0]), ("s", "b", "x" * 40, [0.99, 0.01]), ("s", "c", "x" * 30, [0.0, 1.0]), ("s", "d", "short", [0.5, 0.5]), ("t", "e", "x" * 30, [1.0, 0.0])]
    got = {r.drawer_id: r.kept for r in compression.without_near_duplicates(spark.createDataFrame(rows, "source_file string, drawer_id string, document string, v array<double>")).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True}


def test_cutting():
    assert chunking.cut("") == [] and chunking.cut("x" * 49) == [] and chunking.cut("x" * 50) == ["x" * 50]
    text_ = ("a" * 500 + "\n\n") * 4
    pieces = chunking.cut(text_)
    assert pieces[0] == "a" * 500 and all(len(p) <= 800 for p in pieces)
    assert [len(p) for p in chunking.cut("b" * 1600)] == [800, 800, 200]


def test_closets(spark):
    doc = 'We built the new parser today.\n# Release notes\nAlice met Bob. Alice saw Bob. "a quote of sixteen chars" said Alice.'
    row = spark.createDataFrame([(doc,)], "t string").select(chunking.closet_lines(F.col("t"), F.array(*map(F.lit, "1234")), F.lit("w/r/f")).alias("l"), chunking.closet_lines(F.lit(None).cast("string"), F.array(F.lit("1")), F.lit("w/r/f")).alias("none")).first()
    assert row.l[0].startswith("built the new parser today") and any(x.startswith("release notes|") for x in row.l) and row.l[-1].startswith('"a quote of sixteen chars"|Alice;Bob|→1,2,3')
    assert row.none == ["w/r/f||→1"]
    packed = spark.range(1).select(chunking.pack(F.array(*[F.lit("x" * 700) for _ in range(3)], F.lit("y" * 2000))).alias("p")).first().p
    assert [len(x) for x in packed] == [1401, 700, 2000]
    assert spark.range(1).select(chunking.closet_drawers(F.lit("a||→d1,d2\nb||→d2,d3"))).first()[0] == ["d1", "d2", "d3"]


def test_routing(spark):
    df = spark.createDataFrame([("src/backend/a.py", ""), ("x/planning_notes.md", ""), ("x/readme.md", "the api and the api"), ("x/other.md", "nothing")], "path string, text string")
    got = [r.room for r in chunking.route(df, [("backend", ["api"]), ("planning_notes", ["roadmap"])]).collect()]
    assert got == ["backend", "planning_notes", "backend", "general"]


def test_sessions_are_split(spark):
    lines = ["begin 1"] + ["x"] * 12 + ["begin 2", "Ctrl+E to show"] + ["y"] * 12 + ["begin 3"] + ["z"] * 11
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, "begin 1")], "file string, n int, line string")
    assert [(r.session, r.first_line, r.n_lines) for r in chunking.sessions(df, "^begin").orderBy("session").collect()] == [(1, 0, 27), (2, 27, 12)]


def test_memories_and_moods(spark):
    rows = ["We decided to go with Postgres because it is better than the alternative option", "The bug was fixed, finally it works and I am happy", "I love you and I feel proud, grateful, happy", "nothing of note in this line at all", "short"]
    got = [r.memory_type for r in extraction.memories(spark.createDataFrame([(x,) for x in rows], "content string")).collect()]
    assert got == ["decision", "milestone", "emotional"]


def test_simple_facts(spark):
    df = spark.createDataFrame([(1, "Alice works at Acme Corp. Bob Smith is a doctor, Max loves the chess! Alice prefers Ruby over Python. it works at night")], "id long, document string")
    got = {(r.subject, r.predicate, r.object): r.confidence for r in extraction.facts(df, "id", hints=("Max",)).collect()}
    assert got == {("Alice", "works_at", "Acme Corp"): 0.75, ("Bob Smith", "is_a", "doctor"): 0.7, ("Max", "loves", "chess"): 0.75, ("Alice", "prefers", "Ruby"): 0.6}


def test_facts_trust_hinted_subjects_only(spark):
    df = spark.createDataFrame([(1, "Nora loves Quartz. Quartz loves rain. NORA loves quartz.")], "id long, document string")
    got = {(r.subject, r.object): r.confidence for r in extraction.facts(df, "id", hints=("Quartz",)).collect()}
    assert got == {("NORA", "quartz"): 0.6, ("Quartz", "rain"): 0.75}


def test_people_and_projects(spark):
    lines = ["Alice said yes", "she told Alice", "hey Alice, thanks Alice", "Alice: hello", "we deployed Falcon", "Falcon.py and Falcon-core", "Word Word Word"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "key long, n int, line string")
    names = extraction.entity_candidates(df, "line")
    got = {r.name: r.type for r in extraction.classify_entities(extraction.entity_scores(df, names)).collect()}
    assert got["Alice"] == "person" and got["Falcon"] == "project" and got["Word"] == "uncertain"


def test_queries_are_found_in_prompts(spark):
    prompt = "You are a helpful agent. " * 20
    rows = ["short", prompt + "\nWhat did Alice decide about the database?", prompt + "\nTell me about the cache.\n", "z" * 400]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "q string").select(extraction.clean_query(F.col("q"))).collect()]
    assert got[0] == "short" and got[1] == "What did Alice decide about the database?" and got[2] == "Tell me about the cache." and got[3] == "z" * 250


def test_noise_goes_and_prose_stays(spark):
    said = "> hi\n<system-reminder>\nsecret\n</system-reminder>\nCURRENT TIME: now\nRan 2 Stop hooks\nreal text [12 tokens] (ctrl+o to expand)\n\n\n\n\n\nend"
    code = "Words here\n```\nimport x\n```\n$ ls\ndef f():\nmore words | and such"
    row = spark.createDataFrame([(said, code)], "a string, b string").select(extraction.without_noise(F.col("a")), extraction.prose(F.col("b"))).first()
    assert row[0] == "> hi\nreal text\n\n\nend" and row[1] == "Words here\nmore words | and such"


def test_summaries(spark):
    said = "Yesterday Alice decided to use GraphQL because REST was slow. We love graph-ql. The API server works"
    line = spark.createDataFrame([(said,)], "t string").select(dialect.summary(F.col("t")), dialect.decode(dialect.summary(F.col("t"))).alias("d")).first()
    assert line[0].startswith("0:ALI") and "|determ+love|" in line[0] and line[0].endswith("DECISION+TECHNICAL") and line.d.quote.startswith("Yesterday Alice decided")


def test_storage(spark):
    frame = lambda rows: spark.createDataFrame(rows, "drawer_id string, wing string")
    stored, new = frame([("a", "x"), ("b", "x")]), frame([("b", "y"), ("c", "y")])
    assert {tuple(r) for r in storage.upsert(stored, new).collect()} == {("a", "x"), ("b", "y"), ("c", "y")}
    once = storage.add(stored, new)
    assert {tuple(r) for r in once.collect()} == {("a", "x"), ("b", "x"), ("c", "y")} == {tuple(r) for r in storage.add(once, new).collect()}
    assert {tuple(r) for r in storage.update(stored, frame([("a", None)])).collect()} == {("a", None), ("b", "x")}
    with pytest.raises(KeyError):
        storage.update(stored, new)
    assert ids(storage.delete(stored, new)) == ["a"]


def test_export_and_audit(spark, drawers, tmp_path):
    storage.export_markdown(drawers, str(tmp_path / "md"))
    assert "walnut bowls" in "".join(r.value for r in spark.read.text(str(tmp_path / "md/wing=workshop/room=wood")).collect())
    entries = spark.createDataFrame([("t", "add", {"content": "abc", "wing": "w"})], "timestamp string, operation string, params map<string,string>")
    storage.audit(entries, str(tmp_path / "wal"))
    assert json.loads(spark.read.text(str(tmp_path / "wal")).first()[0])["params"] == {"content": "[redacted 3 chars]", "wing": "w"}


def test_dates(spark):
    row = spark.createDataFrame([("1970-01-02T23:59:59+14:00", "junk", "1960-01-01")], "a string, b string, c string").select(*[dates.iso_to_days(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == (1, 0, 0)
    asked = ["what happened 3 days ago?", "last week", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in asked], "q string").select(dates.days_ago(F.col("q"))).collect()]
    assert tuple(got[0]) == (3, 2) and tuple(got[1]) == (7, 3) and got[2] is None


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1)], "query string, rank int, relevant int")
    totals = spark.createDataFrame([("q", 4)], "query string, relevant int")
    got = {r.k: r for r in metrics.at_k(ranking, totals, (1, 3)).collect()}
    assert got[1].recall_any == 0 and got[1].ndcg == 0 and got[3].recall == 0.5 and got[3].ndcg == pytest.approx((0.63093 + 0.5) / 1.63093, abs=1e-4)
    assert spark.range(1).select(metrics.token_f1(F.lit("the cat sat"), F.lit("The cat, the dog"))).first()[0] == pytest.approx(4 / 7)


def test_essential_story_fits(spark, drawers):
    got = storage.essential(drawers.withColumn("importance", F.lit(3.0)), n=3, most=170).collect()
    assert 1 <= len(got) < 3 and all(r.used <= 170 for r in got)


CHATS = {
    "quoted": "> hi\nhello\n> more\nyes\nsure\n> end\nbye",
    "agent": "\n".join(json.dumps(x) for x in [
        {"type": "user", "message": {"content": "run it"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "a.py"}]}}, {"type": "assistant", "message": {"content": "done"}},
    ]),
    "session": "\n".join(json.dumps(x) for x in [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "yo"}}]),
    "export": json.dumps({"messages": [{"role": "human", "content": "hi"}, {"sender": "assistant", "text": "yo"}]}),
    "privacy": json.dumps([{"chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "yo"}]}]),
    "mapping": json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["a"]}, "a": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}, "children": ["b", "c"]}, "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["yo"]}}, "children": []}, "c": {"parent": "a", "children": []}}}),
    "channel": json.dumps([{"type": "message", "user": "u1", "text": "hi"}, {"type": "message", "user": "u2", "text": "yo"}, {"type": "join"}, {"type": "message", "user": "u3", "text": "me too"}]),
    "none": "just a note",
    "one": json.dumps({"messages": [{"role": "user", "content": "hi"}]}),
}


def test_chat_forms(spark):
    got = {}
    for r in chats.conversation_turns(spark.createDataFrame([*CHATS.items(), ("null", None)], "path string, document string")).orderBy("path", "turn").collect():
        got.setdefault(r.path, []).append((r.role, r.text))
    pair = [("user", "hi"), ("assistant", "yo")]
    assert {k: got.get(k) for k in ("session", "export", "privacy", "mapping")} == dict.fromkeys(("session", "export", "privacy", "mapping"), pair)
    assert got["channel"] == [*pair, ("user", "me too")]
    assert got["quoted"] == [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes\nsure"), ("user", "end"), ("assistant", "bye")]
    assert got["agent"] == [("user", "run it"), ("assistant", "ok\n[Bash] ls\n→ a.py\ndone")]
    assert not {"none", "one", "null"} & set(got)


def test_project_scan(spark, tmp_path):
    made = {"a.py": "x", "sub/b.md": "y", "sub/skip.log": "z", "node_modules/c.py": "n", "build_out/d.py": "o", "sub/keep.tmp.md": "k", "docs/e.md": "e", "chat.meta.json": "{}"}
    for name, body in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rules = [("", ["*.tmp.md", "/build_out/", "docs/**"]), ("sub", ["!keep.tmp.md"])]
    assert ids(files.scan_project(spark, str(tmp_path), rules), "path") == ["a.py", "chat.meta.json", "sub/b.md", "sub/keep.tmp.md"]
    assert "docs/e.md" in ids(files.scan_project(spark, str(tmp_path), rules, include=["docs"]), "path")
    assert ids(files.scan_conversations(spark, str(tmp_path)), "path") == ["docs/e.md", "sub/b.md", "sub/keep.tmp.md"]


def test_diary(spark, tmp_path):
    (tmp_path / "2026-01-02.md").write_text("intro that is long enough to count as a diary\n## one\ntext\n## two\nmore")
    (tmp_path / "2026-01-03.md").write_text("## short")
    rows = files.scan_diary(spark, str(tmp_path)).orderBy("entry").collect()
    assert [(r.day, r.entry, r.text.split("\n")[0]) for r in rows] == [("2026-01-02", 0, "## one"), ("2026-01-02", 1, "## two")]


def test_streams_match_their_batch_twins(spark, sf, tmp_path):
    from recallgrid.sources.tables import activity, turns

    turns(spark, sf).repartition(1).write.parquet(str(tmp_path / "turns"))
    live = spark.readStream.schema(turns(spark, sf).schema).parquet(str(tmp_path / "turns"))
    q = incremental.save_points_stream(live, 2).writeStream.format("memory").queryName("saves").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("saves").collect()} == {tuple(r) for r in incremental.save_points(turns(spark, sf), 2).collect()}

    events = activity(spark, sf)
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = incremental.tumbling(live, late="1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("events")).first()[0] == events.count()


def test_dirty_marks_outlive_their_batch(spark, tmp_path):
    """19 containers in one batch and one in the next make 20: all are rebuilt then, and the marks start anew."""
    folder, done = str(tmp_path / "in"), []
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "container string")
    first = [f"room {i:02d}" for i in range(19)]
    for names in (first + first, ["room 00", "diary", "_registry"], ["room 19"], ["room 00"]):
        frame(names).coalesce(1).write.mode("append").parquet(folder)
        live = spark.readStream.schema("container string").parquet(folder)
        incremental.rebuild_dirty(live, lambda rows: done.append(sorted(r[0] for r in rows.collect())), str(tmp_path / "marks"), str(tmp_path / "at")).awaitTermination()
        if names != ["room 00"] and "room 19" not in names:
            assert done == []
    assert done == [sorted([*first, "room 19"])]
    assert incremental.due(incremental.dirty_containers(frame(first))).count() == 0
    assert incremental.due(incremental.dirty_containers(frame([*first, "x"]))).count() == 20


def test_ingest_sees_a_file_once(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "drawer_id string, document string")
    folder, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    frame([("a", "x"), ("a", "x"), ("b", "y")]).write.parquet(folder)
    incremental.ingest(spark, folder, frame([("", "")]).schema, out, at).awaitTermination()
    frame([("c", "z")]).write.mode("append").parquet(folder)
    incremental.ingest(spark, folder, frame([("", "")]).schema, out, at).awaitTermination()
    assert ids(spark.read.parquet(out)) == ["a", "b", "c"]


def test_text_functions(spark):
    row = spark.createDataFrame([("The quick_fox, a fox-trot 9 lives! x", None)], "t string, n string").select(
        text.tokens(F.col("t")).alias("tokens"), text.tokens(F.col("n")).alias("none"), text.token_estimate(F.col("n")).alias("one"), text.sentences(F.lit("a. b!\n\nc")).alias("s"),
        text.shingles(F.array(*map(F.lit, "abc")), 2).alias("two"), text.shingles(F.array(F.lit("a")), 3).alias("few"), text.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), text.best_topic(F.lit("the schema and api design")).alias("topic"),
    ).first()
    assert row.tokens == ["quick_fox", "fox-trot", "lives"] and row.none == [] and row.one == 1 and row.s == ["a", "b", "c"]
    assert row.two == ["a b", "b c"] and row.few == ["a"] and row.j == 0.5 and row.topic == "architecture"


def test_segments_by_speaker(spark):
    talk = "intro\n> hi\nyo\nHuman: a\n  assistant : b\nrest"
    rows = spark.createDataFrame([(1, talk), (2, " one \n\n\n two"), (3, "\n".join(f"l{i}" for i in range(30))), (4, None), (5, "> a\n> b")], "id long, document string")
    got = {}
    for r in chunking.segments(rows, "id").orderBy("id", "segment").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got == {1: ["intro", "> hi\nyo", "Human: a", "  assistant : b\nrest"], 2: ["one", "two"], 3: ["\n".join(f"l{i}" for i in range(25)), "\n".join(f"l{i}" for i in range(25, 30))], 5: ["> a\n> b"]}


def test_session_heads(spark):
    rows = [("a", ["x", "⏺ 9:05 AM Monday, March 7, 2024", "/Users/kay/work", "> git push", "> hey", "> Plan: the new (shed) roof", "noRA said"]), ("b", []), ("c", None)]
    got = {r.file: r for r in chunking.session_heads(spark.createDataFrame(rows, "file string, lines array<string>"), ["Nora", "Otto"], {"kay": "Kay", "lee": "Lee"}).collect()}
    assert (got["a"].stamp, got["a"].day, got["a"].people, got["a"].subject) == ("2024-03-07_905AM", "2024-03-07", ["Kay", "Nora"], "Plan-the-new-shed-roof")
    assert all((got[k].stamp, got[k].people, got[k].subject) == (None, [], "session") for k in "bc")


def test_models_are_call_backs(spark):
    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "boom"), (4, " "), (5, None)], "id long, document string").repartition(5, "id")

    def model(said):
        if "boom" in said:
            raise RuntimeError("no answer")
        return ['```json\n[{"subject": "Nora", "predicate": "Lives In", "object": "Oslo", "confidence": 3, "valid_from": null},]\n```'.replace(",]", "]") if s == "good" else "none" for s in said]

    answers = models.ask(texts, "id", "document", model)
    facts = models.parse_facts(answers, "id")
    assert [tuple(r) for r in facts.collect()] == [(1, "Nora", "lives_in", "Oslo", 0.9, None)]
    assert tuple(models.extraction_stats(answers, facts, "id").first()) == (3, 1, 1, 1)
    vectors = models.embed(texts, "id", "document", lambda said: [[len(s), 1] for s in said])
    assert {r.id: r.v for r in vectors.collect()} == {1: [4.0, 1.0], 2: [3.0, 1.0], 3: [4.0, 1.0], 4: [1.0, 1.0], 5: [0.0, 1.0]}


def test_learned_compression_is_a_call_back():
    hits = pd.DataFrame({"position": [0, 1], "document": ["Quiet cats sleep all day long", "Loud dogs bark"]})
    got = compression.compress(hits, "learned", lambda text, budget: f"{text.split()[1]} {budget}", budget=10)
    assert got["document"].tolist() == ["cats 5", "dogs 5"] and got["output_tokens"].tolist() == [2, 2]
    assert compression.compress(hits, "learned")["document"].tolist() == hits["document"].tolist()
    with pytest.raises(ValueError):
        compression.compress(hits, "unheard of")


def test_known_names(spark):
    people = spark.createDataFrame([("Rose ", "aunt", "personal"), ("Rose", "boss", "work"), ("Maxwell", None, None), ("", "x", "y"), (None, "x", "y")], "name string, relationship string, context string")
    known = registry.entities(people, spark.createDataFrame([("Max", "Maxwell"), ("Nobody", "None")], "alias string, name string"))
    got = {r.name: (r.canonical, r.aliases, r.contexts, r.relationship, r.ambiguous) for r in known.collect()}
    assert got == {"Rose": ("Rose", [], ["personal", "work"], "aunt", True), "Maxwell": ("Maxwell", ["Max"], ["personal"], "", False), "Max": ("Maxwell", ["Maxwell"], ["personal"], "", True)}
    mentions = spark.createDataFrame([("MAX",), ("rose",), ("who",)], "name string")
    assert {r.name: r.canonical for r in registry.resolve(mentions, known).collect()} == {"MAX": "Maxwell", "rose": "Rose", "who": None}
    assert {r.name for r in registry.protected_names(known).collect()} == {"rose", "max", "maxwell"}


def test_reports(spark, drawers):
    found = search.hybrid_search(drawers, {}, None, ["walnut"], n=5)
    assert search.memories(found).columns == ["text", "wing", "room", "source_file", "similarity"]
    assert "[1] outdoors / trips" in search.report(found, "walnut?") and "ferry.txt" in search.report(found, "walnut?")
    assert search.report(search.hybrid_search(drawers, {}, None, ["absent"], n=5), "q") == 'No results found for: "q"'
