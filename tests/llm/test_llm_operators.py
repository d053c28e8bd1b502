"""The operators against brute force, libraries and SQL on a small table, and on awkward rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallgrid.llm import bpe, chat, fertility, linededup, phraseindex, quality, queries, simhash, sitetree, tokencount, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "x", "a\r\nb \x0b c", "É é ÉÉ ß ẞ İ Σς ﬁ 日本語 テスト 한국어 🎉", "word " * 5000, "ab" * 30000, "<|endoftext|> Foo <|startoftext|>bar", "don't  we'LL 12345 \x85\xa0 ", "same line that repeats here\nsame line that repeats here", "n\0ul \x1c\x1f"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5], (None, "nameless text of a row", "fr", None, None), (None, None, None, None, None), (100, ODD[6], "en", "s", 1), (101, ODD[10], "en", "s", 1), (102, ODD[10], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("block", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).withColumnRenamed("block", "__x")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return df.select("doc_id", "text").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def base_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_fertility_base(table, request):
    df = request.getfixturevalue(table)
    got = fertility.judge(df, P.path("piece_bpe_32k.model")).collect()
    want = Counter((d, *base_counts(t)) for d, t in rows_of(df))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_fertility_measures_and_bands(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    measured = fertility.measure(docs, P.path("piece_bpe_32k.model")).cache()
    texts = dict(map(tuple, rows_of(docs)))
    for r in measured.limit(60).collect():
        ids = [i for w in words(texts[r.id]) for i in sp.encode(w)]
        p = [c / len(ids) for c in Counter(ids).values()]
        assert r.n_tokens == len(ids)
        assert r.entropy == pytest.approx(-sum(x * math.log2(x) for x in p))
        assert r.chars_per_token == pytest.approx(r.word_chars / len(ids))
        assert r.byte_share == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids))
    limits = {(b["of"], b["length"]): b for b in fertility.bands(measured, least_rows=5).collect()}
    assert ("all", -1) in limits and all(b["lo_entropy"] < b["hi_entropy"] for b in limits.values())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_every_row_is_held_against_a_band(table, request):
    """kept, from exact quartiles in plain Python; rows of rare languages and lengths are judged too."""
    df = request.getfixturevalue(table)
    path = P.path("piece_bpe_32k.model")
    rows = fertility.measure(df, path).collect()
    levels = lambda r: [(a, b) for b in (r["size"], -1) for a in (r.key, r.script, "all")]
    groups = defaultdict(list)
    for r in rows:
        for i, g in enumerate(levels(r) if r.n_tokens else []):
            groups[i, g].append(r)
    want = Counter()
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        kept = not failed
        if r.n_tokens:
            group = next(groups[i, g] for i, g in enumerate(levels(r)) if len(groups[i, g]) >= 40 or i == 5)
            for m, least in fertility.LEAST_WIDTH.items():
                values = sorted(x[m] for x in group)
                low, high = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.75))
                width = max(3 * (high - low), least)
                kept = kept and low - width <= r[m] <= high + width
        want[r.id, kept] += 1
    assert Counter((r.doc_id, r.kept) for r in fertility.judge(df, path).collect()) == want


def test_scripts():
    for text, want in [("", "none"), ("12 !", "none"), ("aé", "latin"), ("aЖ", "latin"), ("aЖж", "cyrillic"), ("日本語テスト", "kana"), ("日本語", "han"), ("한국어 ok", "hangul"), ("x" * 70_000 + "Ж", "latin")]:
        assert fertility.script(text) == want, text


def test_noise_falls_out_of_its_band(spark):
    r = random.Random(3)
    prose = [" ".join(r.choice(["the", "house", "under", "water", "never", "people", "little", "answer", "and", "of"]) + r.choice(["", "", ".", ","]) for _ in range(120)) for _ in range(200)]
    noise = ["".join(r.choice("#*%&@!^~") * 3 + " " for _ in range(60)), " ".join(chr(0x1F300 + r.randrange(200)) for _ in range(60))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(prose + noise)], DOCS)
    kept = {x.doc_id: x.kept for x in fertility.judge(df, P.path("piece_bpe_32k.model")).collect()}
    assert sum(not kept[i] for i in range(200)) == 0
    assert not kept[201]


# 3


def fingerprint(text):
    w = [x.encode().lower().decode() for x in words(text)]
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(codes, most=2):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_simhash(table, request):
    df = request.getfixturevalue(table)
    got = simhash.near_duplicates(df).collect()
    codes = [(d, fingerprint(t)) for d, t in rows_of(df)]
    root = reach({c for _, c in codes})
    least = defaultdict(list)
    for d, c in codes:
        if d is not None:
            least[root[c]].append(d)
    want = Counter((d, f"{c:016x}", min(least[root[c]], default=None)) for d, c in codes)
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("most_frequent", [1, 3, 1000])
def test_frequent_classes_keep_all_rows(spark, most_frequent):
    rows = [(i, i % 7 if i < 70 else 100) for i in range(130)] + [(None, 100), (None, 5)]  # 100 has 61 of 132 rows, the others 10 or 11
    sizes = Counter(c for _, c in rows)
    labels = spark.createDataFrame([(c, n, None if c == 2 else c * 10) for c, n in sizes.items()], "own long, n long, component_id long")
    got = simhash.labelled(spark.createDataFrame(rows, "id long, fp long"), labels, "fp", most_frequent).select("id", "fp", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((i, c, None if c == 2 else c * 10) for i, c in rows)


def test_gray_links_are_whole(spark):
    """Random clusters and a dense one, over many ranges."""
    r = random.Random(5)
    codes = set()
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(20):
            codes.add(c)
            for _ in range(r.randrange(4)):
                c ^= 1 << r.randrange(64)
    hub = r.getrandbits(64)
    codes |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(0, 64, 3)}
    import numpy as np

    array = np.array(sorted(codes), np.uint64)
    rank = (simhash.gray_rank(array) ^ np.uint64(1 << 63)).view(np.int64)
    df = spark.createDataFrame([(int(f), int(k)) for f, k in zip(array.view(np.int64), rank, strict=True)], "fp long, rank long")
    stars = simhash.star_components(simhash.links(df, 2, 64)).collect()
    got = {x.node % 2**64: x.root % 2**64 for x in stars}
    groups = defaultdict(set)
    for c in codes:
        groups[got.get(c, c)].add(c)
    want = defaultdict(set)
    for c, root in reach(codes).items():
        want[root].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 5 in ids and ids.count(5) == 1 and 0 in ids and 1 not in ids and 100 not in ids


def similar(texts, shingle=5, similarity=0.8):
    """Each id's smallest id reachable over pairs of texts whose sets of shingles are equal or similar enough."""
    sets = {}
    for d, t in texts.items():
        w = [x.encode().lower().decode() for x in words(t)]
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    holders, root = defaultdict(list), {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        for other in {x for s in sets[d] for x in holders[s]} | ({x for x in sets if not sets[x]} if not sets[d] else set()):
            shared, union = len(sets[d] & sets[other]), len(sets[d] | sets[other])
            if shared >= similarity * union - 1e-9:
                a, b = top(d), top(other)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: top(d) for d in sets}


@pytest.mark.parametrize("range_size", [simhash.SIMILAR_RANGE, 32])
def test_similar_groups(spark, docs, range_size):
    """Edited copies at similarities around the limit, a dense family of them, copies, and the synthetic documents."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {d: t for d, t in map(tuple, rows_of(docs))}

    def put(w):
        texts[10_000 + len(texts)] = " ".join(w)

    for n, edits in [(60, 1), (120, 1), (120, 2), (300, 4), (300, 6), (300, 8), (20, 1), (4, 0), (1, 0)]:
        for _ in range(4):
            base = [r.choice(vocabulary) for _ in range(n)]
            put(base)
            put([x.upper() for x in base])
            for _ in range(2):
                own = list(base)
                for _ in range(edits):
                    own[r.randrange(n)] = f"edit{r.random()}"
                put(own)
    base = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(150):
        own = list(base)
        for _ in range(3):
            own[r.randrange(200)] = f"edit{r.random()}"
        put(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(df, range_size=range_size).collect()}
    want = similar(texts)
    pairs = lambda m: sum(m[d] != d for d in m)
    assert got.keys() == want.keys() and all(want[d] == want[c] for d, c in got.items())  # nothing is joined that isn't similar
    assert pairs(got) >= 0.99 * pairs(want) > 150
    if range_size == simhash.SIMILAR_RANGE:
        assert got == want


def test_keep_one_similar(spark, odd, none):
    rows = simhash.keep_one_similar(odd).collect()
    want = similar({d: t for d, t in rows_of(odd) if d is not None})
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in rows) == 2 and set(rows[0].asDict()) == set(odd.columns)
    assert simhash.keep_one_similar(none).count() == 0


# 4


def deduplicated(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders, owner = Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k] += 1
                owner[k] = max(owner.get(k, -math.inf), -math.inf if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (holders[key(x)] >= 3 and owner[key(x)] != (-math.inf if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_line_dedup(table, request):
    df = request.getfixturevalue(table)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter(map(tuple, linededup.line_digests(out).collect())) == deduplicated(rows_of(df))
    assert linededup.dedup_lines(out).columns == out.columns


def test_minimal_perfect_hash():
    import numpy as np

    for n in (0, 1, 2, 63, 5000):
        hi, lo = np.random.default_rng(n).integers(0, 2**63, (2, n)).astype(np.uint64)
        mph = linededup.MinimalPerfectHash(hi, lo)
        assert mph.size == n and sorted(mph.slots(hi, lo).tolist()) == list(range(n))


# 5


def test_conversation_orders_and_spans(spark):
    rows = [(1, 2, "assistant", "b </turn> \\### x"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "assistant", ""), (2, 1, "we:ird\nrole", "t\n\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    turns = "\nfirst\nuser\n\nuser\n\nassistant\nb </turn> \\### x\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == len("b </turn> \\### x") and got[None].loss_chars == 0 and got[2].loss_chars == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        turns = [("".join(r.choice(["\\", "###", "</turn>", ":", "\n", "a", "<", "#", "é"]) for _ in range(r.randrange(8))), "".join(r.choice(["\\", "###", "</turn>", ": ", "\n", "<", "/turn>", "x"]) for _ in range(r.randrange(12)))) for _ in range(3)]
        assert chat.read_turns(chat.turn_template(turns)) == turns


def test_rewritten_history_is_found():
    def strips(turns):
        return "".join(f"[{role}]{text if i == len(turns) - 1 else text.split('|')[-1]}" for i, (role, text) in enumerate(turns))

    found = chat.locate(strips, [("user", "hi"), ("assistant", "think|answer"), ("user", "more"), ("assistant", "done")])
    assert [k for k, _ in found.rewritten] == [2] and found.spans[0] and found.spans[1] is None
    assert found.text[slice(*found.contents[3])] == "done"
    plain = chat.locate(lambda t: "<s>" + "".join(f"{a}={b};" for a, b in t), [("u", "x"), ("a", "x;x")])
    assert not plain.rewritten and [plain.text[slice(*c)] for c in plain.contents] == ["x", "x;x"]


# 6


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").limit(40)
    more = spark.createDataFrame([(9001, "http://a/ b\r\n", None), (9002, None, ""), (9003, "u", "é" * 70000), (9004, "u", "é" * 70000), (9004, "u", "é" * 70000), (None, "u", "é" * 70000), (None, None, "alone")], "page_id long, url string, html string")
    df = pages.union(more)
    got = Counter(map(tuple, warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    rows = df.collect()
    largest = {}
    for p, _, h in rows:
        if p is not None:
            largest[h or ""] = max(largest.get(h or "", p), p)
    want = Counter()
    for p, _, h in rows:
        data, to = (h or "").encode(), largest.get(h or "")
        to = None if to is None or to == p else to
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert got == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "x" * 50), (4, "u", "x" * 50)], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.archive_pages(df, least_bytes=10).collect()} == {1: None, 2: None, 3: 4, 4: None}


# 7


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_token_counts(table, request):
    df = request.getfixturevalue(table)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows_of(df))
    assert Counter(map(tuple, tokencount.count_tokens(df, P.path("word_bpe_49k.json"), block_chars=50_000).collect())) == want


# 8


def hits(text, items):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = lower(text), set(), set()
    for item, t in items:
        v = lower(t)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)


def test_phrases(spark, docs, odd, none, sf):
    r = random.Random(2)
    few = list("abcdefg")
    synthetic = [(1000 + i, " ".join(r.choice(few) for _ in range(60)), "en", "s", 0) for i in range(20)]
    items = [(1, " ".join(r.choice(few) for _ in range(30))), (2, "A b"), (3, "g"), (4, ""), (5, None), (None, "c d e"), (6, "ÉA日本 nameless"), (2, "A b"), (7, "NAMELESS text, of a row")]
    synthetic.append((2000, f"x {items[0][1].upper()} y {items[0][1]}", "en", "s", 0))
    tests = spark.createDataFrame(items, "item_id long, text string")
    for df, bench in ((spark.createDataFrame(synthetic, DOCS).union(odd.drop("__x")), tests), (none, tests), (odd, tests.limit(0))):
        got = phraseindex.contamination(df, bench).collect()
        listed = [tuple(x) for x in bench.collect()]
        want = Counter((d, *(str(x) for x in hits(t, listed))) for d, t in rows_of(df))
        assert Counter((x.doc_id, str(x.n_words), str(x.n_hit), str(x["items"]), str(x.contaminated)) for x in got) == want
    kept = phraseindex.decontaminate(odd, tests)
    assert kept.columns == odd.columns
    assert Counter(map(tuple, rows_of(kept))) == Counter((d, t) for d, t in rows_of(odd) if not hits(t, items)[3])


def test_proximity(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "three x x x x x x one two"), (3, "two THREE x one"), (4, None)], "doc_id long, text string")
    phrases = phraseindex.Phrases.of(spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    index = phraseindex.PositionalIndex.build(df, phrases.vocabulary)
    ids = {r.row: r.id for r in index.headers().collect()}
    assert sorted(ids[r.row] for r in index.proximity(phrases, 4).collect()) == [1, 3]
    assert sorted(ids[r.row] for r in index.proximity(phrases, 3).collect()) == [1]


# 9


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    out = [d for d in got if d in marks and got[d].held_out]
    assert len(out) > 50 and sum(got[d].predicted == marks[d] for d in out) / len(out) > 0.9
    good, bad = [got[d].score for d in out if marks[d]], [got[d].score for d in out if not marks[d]]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9
    import zlib

    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    kept = quality.keep_good(docs, labels)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d in got if got[d].predicted}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (6, 0, 1), (5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.score == 0.5 for r in quality.score_documents(odd, labels.limit(0)).collect())
    assert quality.score_documents(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


def test_isotonic_values_rise():
    at, value = quality.isotonic([0, 1, 2, 3, 4], [0, 1, 0.5, 0.2, 1], [1, 1, 1, 1, 1])
    assert list(value) == sorted(value) and len(value) == 3 and value[1] == pytest.approx(1.7 / 3)


# 10


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_bpe(table, request, library):
    df = request.getfixturevalue(table)
    want = Counter()
    for d, t in rows_of(df):
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    path = P.path("byte_bpe_50k.tiktoken")
    assert Counter(map(tuple, bpe.round_trip(df, path, P.PATTERN).collect())) == want
    coded = bpe.encode_texts(df, path, P.PATTERN)
    assert coded.columns == [*df.columns, "ids"]
    assert all(r.decoded == (r.text or "") for r in bpe.decode_ids(coded, path).collect())


def test_small_caches_change_nothing(library):
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, r = bpe.Transducer(ranks, most_states=30), random.Random(4)
    for _ in range(300):
        piece = "".join(r.choice("abtheingЖяы日本é 0=") for _ in range(r.randrange(1, 40))).encode()
        assert machine.encode(piece) == bpe.merge_by_rank(piece, ranks)
    assert machine.encode(b"") == [] and whole.n_vocab


def test_decoding_across_chunks():
    ranks = {bytes([i]): i for i in range(256)}
    bytes_of = {i: t for t, i in ranks.items()}
    for data in ("aé日🎉z".encode(), b"\xff\xe6\x97", b"\xf0\x9f\x8e", b"\xe0\x80a\xed\xa0\x80", b"\xc3"):
        for chunk in (1, 2, 3, 100):
            assert bpe.decode(list(data), bytes_of, chunk) == data.decode("utf-8", "replace")


# All


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    order = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(order)
    assert Counter(map(tuple, got.select(*order).collect())) == Counter(want.fetchall())


# 2


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_pages(spark):
    cases = {
        page("<nav>menu</nav><article><h1>A  &amp; B</h1><p>One<br>two <b>th</b>ree.<p>Four &lt;x&gt;</article><footer>f</footer>"): "A & B One two three. Four <x>",
        page('<div class="ad">buy</div><div id="content"><p>Text here</p></div><aside>side</aside><form><p>mail</p></form>'): "Text here",
        page('<article><p>Body<p>More</p><div class="comments"><p>reader</p></div><script>var a="</p>";</script><style>p{}</style></article><section id="comments">c</section>'): "Body More",
        "<p>no frame, <i>cut of": "no frame, cut of",
        page("<article><script>if (a<b) { x('</div>\"<!--') }</script><p>Seen<script>never closed <p>x"): "Seen",
        "<article><p>cut <a href='x": "cut",
        page("<!-- c <p>x</p> --><main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>"): "a b c d",
        "": "",
        page("<p>unquoted <a href=x>link</a>&nbsp;end &copy; &unknown;</p>"): "unquoted link end © &unknown;",
    }
    df = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in enumerate(cases)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in sitetree.extract(df).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[99].text == "" and sitetree.extract(df.limit(0)).count() == 0


def test_host_template_is_removed(spark):
    """A menu, a notice and a box without telling names or tags, on every page of a host; one host has copies only."""
    r = random.Random(8)
    words = ["river", "stone", "lamp", "garden", "paper", "cloud", "engine", "bread", "violet", "north"]
    rows = []
    for i in range(40):
        own = " ".join(r.choice(words) for _ in range(30))
        rows.append((i, f"https://site.example/{i}", page(f'<div class="x1"><p>Home Products Contact</p></div><div class="y2"><p>{own}</p></div><div class="z3"><span>All rights {r.choice("ABC")}</span></div>')))
    rows += [(100 + i, f"https://copies.example/{i}", page('<div class="b"><p>One text for all pages</p></div>')) for i in range(30)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows[:40]:
        assert got[i] == re.search(r'"y2"><p>(.*?)</p>', html)[1]
    assert all(got[100 + i] == "One text for all pages" for i in range(30))


def test_made_pages_give_their_articles(spark, sf):
    """On the synthetic pages: what stands in <article>, by a plain reading of that element."""
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"<[a-z/]*\Z", "", inner))]
        assert got[p.page_id] == " ".join(filter(None, blocks))


def test_tree_decides_inside_and_outside_articles(spark):
    """Boxes and lines that a host repeats within its articles go, own text beside an article stays; near copies keep theirs."""
    r = random.Random(9)
    words = ["river", "stone", "lamp", "garden", "paper", "cloud", "engine", "bread", "violet", "north"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, want = [], {}

    def put(host, body, text):
        rows.append((len(rows), f"https://{host}.example/{len(rows)}", page(body)))
        want[len(rows) - 1] = text

    for _ in range(30):  # a box with a path of its own, and a line among the paragraphs
        a, b, c = say(20), say(25), say(12)
        put("large", f'<article><h1>{a}</h1><div class="q7"><p>Read more stories like this one</p></div><p>{b}</p><p>All rights remain with us</p></article><div class="own"><p>{c}</p></div><div class="z3"><p>Home Products</p></div>', f"{a} {b} {c}")
    base = [say(40) for _ in range(6)]
    for i in range(30):  # near copies: one word differs, in a paragraph each
        own = list(base)
        own[i % 6] += f" edit{i}"
        put("near", "<article><h1>One title</h1>" + "".join(f"<p>{x}</p>" for x in own) + "</article>", " ".join(["One title", *own]))
    for _ in range(4):  # few pages: a tree for what is outside of articles
        a, b = say(20), say(15)
        put("small", f'<article><h1>Same head</h1><p>{a}</p></article><div class="own"><p>{b}</p></div><div class="z3"><p>Home Products</p></div>', f"Same head {a} {b}")
    put("single", '<article><p>Only this</p></article><div class="z3"><p>Home Products</p></div>', "Only this")
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_tree_decides_without_names(spark):
    """No telling tag or name anywhere: the tree alone tells a host's frame from its texts, and without it the frame stays."""
    r = random.Random(10)
    words = ["river", "stone", "lamp", "garden", "paper", "cloud", "engine", "bread", "violet", "north"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    boxes = [say(6) for _ in range(4)]
    rows, want = [], {}
    for host, n in (("big", 60), ("small", 3)):
        for _ in range(n):
            own = [say(20) for _ in range(3)]
            want[len(rows)] = " ".join(own)
            rows.append((len(rows), f"https://{host}.example/{len(rows)}", page(f'<div class="k1"><p>Start Contact</p></div><div class="k2"><p>{boxes[len(rows) % 4] if n > 9 else boxes[0]}</p></div><div class="k3">' + "".join(f"<p>{x}</p>" for x in own) + "</div>")))
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(" ".join(sitetree.Page(h).wanted(set())) != want[i] for i, _, h in rows)


def test_both_ways_to_dull_keys(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", F.regexp_replace("html", "</?(article|nav|footer)>", ""))
    pages = pages.union(pages.limit(20)).withColumn("keys", F.lit("mine")).withColumn("host", F.lit(1))
    pages = pages.union(spark.createDataFrame([(None, None, None, "x", 1), (None, None, None, "x", 1), (7, None, "<p>no host</p>", "x", 1)], pages.schema))
    sent, joined = (sorted(map(tuple, sitetree.extract(pages, most_keys=n).collect()), key=str) for n in (sitetree.MOST_KEYS, 0))
    assert sent == joined and len(sent) == pages.count()
    assert (7, None, "no host", 7) in sent and sent.count((None, None, "", 0)) == 2


def test_spark_and_python_make_the_same_keys(spark):
    rows = [("", 0), ("a.example", -(1 << 63)), ("ü.example", (1 << 63) - 1), ("a.example", 12345)]
    got = spark.createDataFrame(rows, "host string, item long").select("host", "item", F.xxhash64("host", "item").alias("k")).collect()
    assert all(sitetree.key_of(sitetree._seed(r.host), r.item) == r.k for r in got)


def test_depth_costs_no_memory():
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    deep = sitetree.Page("<div>" * n + "in the deep" + "<b>" * n + "</i>" * n + "</div>" * n + "<p>after</p>")
    nodes = deep.features()
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert deep.wanted(set()) == ["in the deep", "after"] and len(nodes) < 600


def test_line_index_tells_lines_that_it_lacks(spark):
    """Other documents probe a stored index: lines that were not built in stay, whatever slot they fall into."""
    import numpy as np

    rng = np.random.default_rng(5)
    hi, lo, other = (rng.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(3))
    n, owner = rng.integers(1, 400, 4000), rng.integers(0, 9999, 4000)
    index = linededup.LineIndex.from_bytes(linededup.LineIndex(hi, lo, n, owner).to_bytes())
    found, owners = index.probe(hi, lo, 3)
    assert (found == (n >= 3)).all() and (owners == owner).all()
    assert not index.probe(hi, other, 1)[0].any() and not index.probe(other, lo, 1)[0].any()

    line = "a line of more than twenty characters, number {}"
    built = spark.createDataFrame([(i, line.format(1) + "\n" + line.format(2 + i)) for i in range(5)], "doc_id long, text string")
    new = spark.createDataFrame([(4, line.format(1), 1), (7, line.format(1) + "\n" + line.format(3) + "\n" + line.format(99), 2), (None, None, 3)], "doc_id long, text string, __block int")
    out = linededup.drop_repeated(new, linededup.line_index(built, 8), 8)
    assert out.columns == ["doc_id", "text", "__block", "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.collect()} == {(4, line.format(1), 1, 1, 0), (7, line.format(3) + "\n" + line.format(99), 2, 3, 1), (None, "", 3, 1, 0)}


def test_clashing_names_are_no_trouble(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"__id": F.lit("a"), "__digest": F.lit(1), "__keep": F.lit(2), "__block": F.lit(3)})
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = phraseindex.decontaminate(docs, items)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one_similar(docs).columns == docs.columns
    assert linededup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
