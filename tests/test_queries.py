"""Every registered query runs, and gives DuckDB's rows where it has SQL."""

import math
from collections import Counter
from decimal import Decimal

import pytest

from recallgrid.plans import registry


def plain(value):
    """A value that compares across engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE_SQL[name])
    order = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(order)
    assert Counter(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in order]).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


#: Queries that SQL can't express; each has a test of its own below, or one that is named here.
BY_HAND = {
    "memories", "heuristic_triples", "entity_detect", "query_sanitize", "noise_and_prose", "chunk_chars", "closet_lines", "closet_pack", "dialect_summary", "cluster_representative", "near_dup_greedy", "novelty_budget", "sentence_dedupe", "ppr_candidates",
}


def test_every_query_is_tested():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == BY_HAND


@pytest.fixture(scope="module")
def said(spark, sf):
    from recallgrid.plans import texts

    return {(r.conv_id, r.turn): r.content for r in texts._said(spark, sf).collect()}


def test_chunk_chars(spark, sf):
    from recallgrid.sources.tables import drawers

    found = {}
    for r in registry.QUERIES["chunk_chars"](spark, sf).orderBy("drawer_id", "chunk_index").collect():
        found.setdefault(r.drawer_id, []).append(r.content)
    for d in drawers(spark, sf).collect():
        text, at, pieces = d.document.strip(), 0, []
        while at < len(text):  # a plain reading: 800 characters, ended at the last blank line or line end of the second half
            end, part = at + 800, text[at : at + 800]
            if end < len(text):
                ends = [i for mark in ("\n\n", "\n") if (i := part.rfind(mark)) > 400]
                end = at + ends[0] if ends else end
            pieces += [p] if len(p := text[at:end].strip()) >= 50 else []
            at = end - 100 if end < len(text) else len(text)
        assert found.get(d.drawer_id, []) == pieces


def test_closets_hold_their_lines(spark, sf):
    from collections import Counter as Count

    from recallgrid.sources.tables import drawers

    texts = {d.drawer_id: d.document for d in drawers(spark, sf).collect()}
    lines = {}
    for r in registry.QUERIES["closet_lines"](spark, sf).orderBy("drawer_id", "n").collect():
        lines.setdefault(r.drawer_id, []).append(r.line)
    assert lines.keys() == texts.keys()
    import re

    for d, own in lines.items():
        words = Count(re.findall(r"\b[A-Z][a-z]{2,}\b", texts[d][:5000]))
        often = [w for w, n in sorted(words.items(), key=lambda x: -x[1]) if n >= 2][:5]  # sorted() keeps the order of first sight
        assert all(x.endswith(f"|{';'.join(often)}|→{d}") for x in own)
    packed = {}
    for r in registry.QUERIES["closet_pack"](spark, sf).orderBy("drawer_id", "closet").collect():
        packed.setdefault(r.drawer_id, []).append(r.document)
        assert r.points_to == [r.drawer_id]
    for d, own in lines.items():
        assert "\n".join(packed[d]).split("\n") == own and all(len(c) <= 1500 or "\n" not in c for c in packed[d])
        assert all(len(a) + 2 + len(b.split("\n")[0]) > 1500 for a, b in zip(packed[d], packed[d][1:], strict=False))


def test_representatives_of_clusters(spark, sf, duck):
    from recallgrid.sources.tables import drawers

    rows = {d.drawer_id: (len(d.document), d.chunk_index) for d in drawers(spark, sf).collect()}
    members = {}
    for d, label in duck.execute("SELECT drawer_id, cluster FROM (" + registry.ORACLE_SQL["jaccard_clusters"] + ")").fetchall():
        members.setdefault(label, []).append(d)
    want = {(min(m, key=lambda d: (-rows[d][0], rows[d][1])), label, len(m), min(rows[d][1] for d in m)) for label, m in members.items()}
    assert {tuple(r) for r in registry.QUERIES["cluster_representative"](spark, sf).select("drawer_id", "cluster", "cluster_size", "first").collect()} == want


def test_greedy_near_duplicates(spark, sf):
    import numpy as np

    from recallgrid.sources.tables import drawers, vectors

    v = {r.vec_id: np.array(r.v) for r in vectors(spark, sf).collect()}
    by_source, want = {}, {}
    for d in drawers(spark, sf).collect():
        if d.chunk_index in v:
            by_source.setdefault(d.source_file, []).append((-len(d.document.strip(" ")), d.drawer_id, v[d.chunk_index]))
    for rows in by_source.values():
        kept = []
        for n, d, x in sorted(rows, key=lambda r: r[:2]):
            near = any(1 - float(x @ y) / (float(np.linalg.norm(x) * np.linalg.norm(y)) or 1) < 0.15 for y in kept)
            want[d] = -n >= 20 and not near
            if want[d]:
                kept.append(x)
    assert {r.drawer_id: r.kept for r in registry.QUERIES["near_dup_greedy"](spark, sf).collect()} == want


def test_compressed_answers(spark, sf):
    import re

    from recallgrid.sources.tables import turns

    texts = {(t.conv_id, t.turn): t.text for t in turns(spark, sf).collect()}
    parts = lambda t: [s.strip() for s in re.split(r"[.!?\n]+", t) if s.strip()]
    for name in ("novelty_budget", "sentence_dedupe"):
        shown = {}
        for r in registry.QUERIES[name](spark, sf).orderBy("query", "position").collect():
            kept, own = r.document.split(". "), parts(texts[r.query, r.position])
            assert [s for s in own if s in kept] and set(parts(r.document)) <= {p for s in own for p in parts(s)}
            assert r.output_tokens == max(1, int(len(r.document.split()) * 13 / 10))
            shown.setdefault(r.query, []).append((r.position, r.output_tokens))
        assert shown.keys() == {c for c, _ in texts}
        assert all(p[0] == min(t for c, t in texts if c == q) for q, (p, *_) in shown.items())  # what comes first is always new
        if name == "novelty_budget":
            assert all(sum(n for _, n in x) <= 400 for x in shown.values())


def test_extraction_over_sayings(spark, sf, said):
    facts = {(r.conv_id, r.subject, r.predicate, r.object): r.confidence for r in registry.QUERIES["heuristic_triples"](spark, sf).collect()}
    talks = {c for c, _ in said}
    assert all((c, "Alice", "works_at", "Acme Corp") in facts and facts[c, "Bob", "loves", "chess"] == 0.6 for c in talks if c % 6 == 1)
    assert all(facts[c, "Alice", "uses", "Postgres"] > 0.6 for c in talks if c % 6 == 4)  # Alice is hinted
    kinds = {r.name: r.type for r in registry.QUERIES["entity_detect"](spark, sf).collect()}
    assert {"Alice", "Postgres"} <= kinds.keys() and set(kinds.values()) <= {"person", "project", "uncertain"}
    found = registry.QUERIES["memories"](spark, sf).collect()
    scores = {(r.conv_id, r.turn): r for r in registry.QUERIES["memory_type_score"](spark, sf).collect()}
    assert found and {(r.conv_id, r.turn) for r in found} <= {k for k, r in scores.items() if max(v for c, v in r.asDict().items() if c not in ("conv_id", "turn")) > 0}
    queries = {(r.conv_id, r.turn): r["query"] for r in registry.QUERIES["query_sanitize"](spark, sf).collect()}
    assert queries.keys() == said.keys() and all(q == said[k].strip() if len(said[k].strip()) <= 200 else len(q) <= 500 for k, q in queries.items())
    prose = {(r.conv_id, r.turn): r.prose for r in registry.QUERIES["noise_and_prose"](spark, sf).collect()}
    assert prose.keys() == said.keys() and all(set(p.split("\n")) <= set(said[k].strip().split("\n")) | {x.strip() for x in said[k].split("\n")} | {""} for k, p in prose.items())


def test_entry(spark):
    assert "drawer_id" in registry.entry(spark).columns


def test_ppr_candidates_over_all_triples(spark, sf):
    """A plain walk over every open triple, orders too."""
    from collections import defaultdict

    from recallgrid.sources.tables import triples

    norm = lambda s: s.lower().replace(" ", "_").replace("'", "")
    facts = triples(spark, sf).collect()
    out = defaultdict(lambda: defaultdict(float))
    for t in facts:
        if t.valid_to is None:
            out[norm(t.subject)][norm(t.object)] += t.confidence
            out[norm(t.object)][norm(t.subject)] += t.confidence
    score = {"nation_7": 1.0}
    for _ in range(200):
        after = defaultdict(float, {"nation_7": 0.15})
        for a, s in score.items():
            for b, w in out[a].items():
                after[b] += 0.85 * s * w / sum(out[a].values())
        score = after
    best = sorted(score, key=lambda n: (-round(score[n], 9), n))[:20]
    want = {f"drawer_{t.object}" for t in facts if t.valid_to is None and {norm(t.subject), norm(t.object)} & set(best)}
    got = {r.drawer_id for r in registry.QUERIES["ppr_candidates"](spark, sf).collect()}
    assert got == want and any(x.startswith("drawer_Order") for x in got)


def test_dialect_summary_reads_whole_texts(spark, tmp_path):
    text = "Plain words of no weight. " * 100 + "We decided to use Quartz because it was the key. I love it."
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["dialect_summary"](spark, str(tmp_path)).first().summary
    assert "QUA" in got and "decided" in got and "love" in got


def test_substring_recall_finds_items_without_whole_runs(spark, tmp_path):
    """Items without a run of letters, with one that is cut or glued to others, short and empty ones, as by the SQL."""
    import duckdb

    items = ["é à ù ô 12 34", "ending then the needle", "short", "x" * 58 + " cutoffhere and more", "one whole needle here", "", "nowhere at all"]
    docs = ["so é à ù ô 12 34 it", "bending then the needles", "ashorter", "x" * 58 + " cutter", "a one whole needle heres", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    items += ["An Item That Holds another document wholly within it"]
    docs += ["that holds ANOTHER document wholly", "xy"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(docs)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["substring_recall"]).fetchall()
    assert {i for i, _ in want} == {0, 1, 2, 4, 5, 7}
    assert sorted(map(tuple, registry.QUERIES["substring_recall"](spark, str(tmp_path)).collect())) == sorted(want)
