"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in few bits tend to stand near each other in Gray order (each code differs from the next
in one bit). GrayIndex sorts fingerprints by their Gray rank and groups neighbours; a node of the tree keeps the
bits on which all its fingerprints agree, less those that the nodes above keep. A search carries the differences
that it has met on the way down and drops a whole group as soon as they exceed the limit.

The same tree works at two levels. Distinct fingerprints are cut into ranges of about equal size in Gray order;
the ranges' shared bits (4096 ranges at most) make a tree that routes every fingerprint to those other ranges that
can hold a neighbour. Each range then builds its own tree and searches it for its own fingerprints and its
visitors. A pair of ranges is searched in one direction only. Every search is exact: a group is dropped only when
its shared bits alone differ in more than the limit.

A range returns, for each fingerprint with a link, one representative of its component there: never all pairs.
The representatives are joined to components by alternating star contractions, each written to the shared folder.

similar_groups() finds edited copies: texts whose sets of shingles have a Jaccard similarity of 0.8, say. Their
fingerprints differ in so many bits that no index can look for all of them. So texts get TABLES fingerprints of
independent bits, each with its Gray-order index. A group of neighbours is dropped when its shared bits differ in
more than such texts' do at that depth in most cases (the accumulated differences against a binomial quantile), and the tables
make up for what one of them misses. Each text proposes its nearest neighbour in a range, never all of a dense group, and
what is proposed is checked exactly, on the sets of shingles. Where that leaves texts with neighbours in different
components, an exact join by the rarest shingles tells whether a pair among these texts links them after all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import freeing, texts_of, unused_name, words_of, write_shared

MOST_RANGES = 1 << 16
#: Classes whose labels are broadcast because of their many rows are fewer than this.
MOST_FREQUENT = 1000
RANGE_SIZE = 2048
#: For similar texts: fingerprints of a text, codes in a range, and the share of similar pairs that one index's upper
#: nodes let through, and the last comparison.
TABLES = 6
SIMILAR_RANGE = 1024
PASS_UPPER, PASS_CODE, PASS_ALL = 0.6, 0.97, 0.998
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = np.uint64(1 << 63)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of words, lower-cased (A-Z) and joined by spaces; fewer words than a shingle are one; no words none."""
    words = words_of(text)
    if not words:
        return np.array([], np.uint64)
    words = [w.lower() for w in words]  # A-Z only, as these are bytes
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have; none without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: set where over half of the shingles' XXH64 have the bit set, repeats included. No words: 0."""
    return int(majority(shingle_hashes(text, shingle, seed)))


class GrayIndex:
    """Finds, among leaves (codes, or patterns with a mask of the bits that count), those within a number of bits."""

    FAN_OUT = 8

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        order = np.argsort(gray_rank(patterns), kind="stable")
        masks = np.full(len(patterns), _ALL) if masks is None else masks[order]
        levels = [(patterns[order] & masks, masks)]
        while len(levels[-1][0]) > self.FAN_OUT:
            below, shared = levels[-1]
            start = np.arange(0, len(below), self.FAN_OUT)
            agree = np.bitwise_and.reduceat(shared, start) & ~(np.bitwise_or.reduceat(below, start) ^ np.bitwise_and.reduceat(below, start))
            levels.append((below[start] & agree, agree))
        self.order = order
        # From the top down; a node's mask loses what its parent's mask has.
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            above = np.repeat(levels[depth + 1][1], self.FAN_OUT)[: len(mask)] if depth + 1 < len(levels) else np.uint64(0)
            own = mask & ~above
            self.levels.append((pattern & own, own))
        self.levels.reverse()

    def search(self, queries: np.ndarray, most: int | np.ndarray, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, number of the leaf), chunk by chunk of queries.

        most: the differences allowed, or, as an array, those allowed after so many bits have been compared.
        """
        for begin in range(0, len(queries), chunk):
            part = queries[begin : begin + chunk]
            top = len(self.levels[0][0])
            query, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            met, compared = np.zeros(len(query), np.uint8), np.zeros(len(query), np.uint8)
            for depth, (pattern, mask) in enumerate(self.levels):
                if depth:
                    size = len(pattern)
                    query, met, compared = (np.repeat(x, self.FAN_OUT) for x in (query, met, compared))
                    node = (node[:, None] * self.FAN_OUT + np.arange(self.FAN_OUT)).ravel()
                    inside = node < size
                    query, met, compared, node = query[inside], met[inside], compared[inside], node[inside]
                met = met + np.bitwise_count((part[query] & mask[node]) ^ pattern[node])
                if isinstance(most, np.ndarray):
                    compared = compared + np.bitwise_count(mask[node])
                    near = met <= most[compared]
                else:
                    near = met <= most
                query, node, met, compared = query[near], node[near], met[near], compared[near]
            yield query + begin, self.order[node]


def components(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the pairs, which are taken chunk by chunk."""
    parent = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = parent[a], parent[b]
            differ = x != y
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            a, b = a[differ], b[differ]
    return parent


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) and rank (its Gray rank, ordered as a long), one row for each of df's."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([simhash(t or "", shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), pa.array((gray_rank(codes) ^ _TOP).view(np.int64))], ["id", "fp", "rank"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, fp long, rank long")


def _accuracy(n_ranges: int) -> int:
    """Of the quantiles that cut ranges: a hundredth of a range, for very many ranges a sixteenth."""
    return max(10_000, min(1_000_000, 100 * n_ranges), 16 * n_ranges)


def links(codes: DataFrame, most_bits: int = 2, range_size: int = RANGE_SIZE) -> DataFrame:
    """From distinct codes (fp, rank): rows (a, b), a different from b, that connect all codes within most_bits of each other.

    b stands for a's component within one range: the rows' components are those of all pairs.
    """
    n = codes.count()
    n_ranges = max(1, min(MOST_RANGES, -(-n // range_size)))
    cuts = np.array([], np.int64)
    if n_ranges > 1:
        at = [i / n_ranges for i in range(1, n_ranges)]
        found = codes.agg(F.percentile_approx("rank", F.array(*[F.lit(x) for x in at]), F.lit(_accuracy(n_ranges))).alias("cuts")).first()
        cuts = np.unique(np.array(found["cuts"], np.int64))

    def own_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(cuts, batch.column(1).to_numpy()).astype(np.int32))], ["fp", "range"])

    ranged = codes.select("fp", "rank").mapInArrow(own_range, "fp long, range int")
    # One row for each of at most MOST_RANGES ranges: the bits on which all its codes agree.
    nodes = ranged.groupBy("range").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).collect()
    numbers = np.array([r["range"] for r in nodes], np.int64)
    every, some = (np.array([r[k] for r in nodes], np.int64).view(np.uint64) for k in ("all", "any"))
    masks = ~(every ^ some)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(every & masks, masks)
        for batch in batches:
            mine, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(np.zeros(len(mine), bool))], ["range", "fp", "visitor"])
            for query, leaf in upper.search(mine.view(np.uint64), most_bits):
                to, at = numbers[leaf], own[query]
                goes = (to != at) & ((at < to) == ((at + to) % 2 == 1))  # one direction for each pair of ranges
                if goes.any():
                    yield pa.RecordBatch.from_arrays([pa.array(to[goes].astype(np.int32)), pa.array(mine[query[goes]]), pa.array(np.ones(int(goes.sum()), bool))], ["range", "fp", "visitor"])

    def search(rows: pa.Table) -> pa.Table:
        fp, visitor = rows.column("fp").to_numpy(), rows.column("visitor").to_numpy(zero_copy_only=False)
        fp = np.concatenate([fp[~visitor], fp[visitor]])
        members = int((~visitor).sum())
        a = b = np.array([], np.int64)
        if members:
            index = GrayIndex(fp[:members].view(np.uint64))
            root = components(len(fp), index.search(fp.view(np.uint64), most_bits))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            a, b = fp[linked], fp[root[linked]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return ranged.mapInArrow(route, "range int, fp long, visitor boolean").groupBy("range").applyInArrow(search, "a long, b long")


def star_components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """From rows (a, b): (node, root) with root the smallest node of the component, for every node but the roots.

    Large and small stars alternate until nothing changes. Each round is written to the shared folder; what it
    gathers is one minimum for each node, so a node with very many neighbours is one row.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, before = write_shared(pairs, name), None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b")))
        pairs = write_shared(small.distinct(), name)


def labelled(rows: DataFrame, labels: DataFrame, key: str, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """rows with the component_id of their class (`key`), from labels (own, n rows of that class, component_id).

    A class of more than one row in most_frequent would make one long task. There are fewer than most_frequent of
    them, so that these are broadcast and their rows stay where they are; the other classes meet by a shuffle.
    """
    labels = write_shared(labels, "labels")
    total = labels.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(labels.where(F.col("n") * most_frequent > total).select("own", "component_id"))
    seldom = labels.where(F.col("n") * most_frequent <= total).select("own", "component_id")
    met = rows.join(often, F.col(key) == F.col("own"))
    others = rows.join(often, F.col(key) == F.col("own"), "left_anti").join(seldom, F.col(key) == F.col("own"))
    return met.union(others)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most_bits: int = 2, seed: int = 42) -> DataFrame:
    """For each row of df: id_col, fingerprint (16 hex digits) and component_id, the smallest id that it reaches.

    Rows with equal fingerprints, or with fingerprints that differ in most_bits bits at most, are linked, and links
    chain. A text of fewer words than a shingle is one shingle; a null text or one without words has fingerprint 0,
    linked like any other. Null ids are ignored in the minimum (component_id is null where a component has no other);
    repeated rows give a row each. Columns of df besides the two aren't carried over. An empty table gives none.
    """
    docs = write_shared(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    codes = write_shared(docs.groupBy("fp", "rank").agg(F.min("id").alias("least"), F.count("*").alias("n")), "codes")
    stars = star_components(links(codes, most_bits))
    linked = stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(codes, linked["node"] == codes["fp"]).groupBy("root").agg(F.min("least").alias("joint"))
    joint = linked.join(least, "root").select("node", "joint")
    labels = codes.join(joint, codes["fp"] == joint["node"], "left").select(codes["fp"].alias("own"), "n", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("joint")).alias("component_id"))
    return labelled(docs, labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most_bits: int = 2, seed: int = 42) -> DataFrame:
    """df without near-duplicates: of each component the row with the smallest id stays, with all its columns.

    A row that stands there several times stays once. Rows with a null id can't be told apart and all stay.
    """
    return _keep_first(df, near_duplicates(df, id_col, text_col, shingle, most_bits, seed), id_col)


def _keep_first(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    own = unused_name(df, "keep")
    keep = found.where(F.col(f"`{id_col}`") == F.col("component_id")).select(F.col(f"`{id_col}`").alias(own)).distinct()
    named = df.join(keep, F.col(f"`{id_col}`") == F.col(own), "left_semi").dropDuplicates([id_col])
    return named.union(df.where(F.col(f"`{id_col}`").isNull()))


def allowed(bits: int, differ: float, share: float) -> int:
    """How many of `bits` bits may differ so that pairs with a chance `differ` for each bit pass in `share` of all cases."""
    total, d = (1 - differ) ** bits, 0
    while total < share and d < bits:
        d += 1
        total += math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d)
    return d


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """id, node (a digest of the text's set of shingles), r0 to r5: the Gray ranks of its fingerprints, ordered as longs."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes, codes = [], []
                for text in texts_of(part.column(1)):
                    hashes = np.unique(shingle_hashes(text, shingle, seed))
                    nodes.append(_node_of(hashes))
                    codes.append([majority(_mixed(hashes, t)) for t in range(TABLES)])
                ranks = (gray_rank(np.array(codes, np.uint64).reshape(-1, TABLES)) ^ _TOP).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), *(pa.array(ranks[:, t].copy()) for t in range(TABLES))], ["id", "node", *_RANKS])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(freeing(run), f"id {kind}, node long, " + ", ".join(f"{r} long" for r in _RANKS))


_RANKS, _CODES = ([f"{x}{t}" for t in range(TABLES)] for x in "rc")


def _node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other bits for each table: the hashes themselves for the first."""
    if not table:
        return hashes
    x = hashes + np.uint64((table * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """node and set (array<long>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in texts_of(batch.column(0).slice(start, 256))]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_node_of(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "set"])

    return df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(freeing(run), "node long, set array<long>")


def proposals(classes: DataFrame, differ: float, range_size: int = SIMILAR_RANGE) -> DataFrame:
    """Distinct pairs (a, b), a less than b, of nodes of classes (node, r0 to r5): for each node in each range its nearest.

    differ: the chance of a bit to differ between fingerprints of texts that are just similar. A node that has any
    neighbour that may be similar is in one pair at least.
    """
    n_ranges = max(1, min(MOST_RANGES, -(-classes.count() // range_size)))
    cuts = [np.array([], np.int64)] * TABLES
    if n_ranges > 1:
        at = F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)])
        found = classes.agg(*[F.percentile_approx(r, at, F.lit(_accuracy(n_ranges))).alias(r) for r in _RANKS]).first()
        cuts = [np.unique(np.array(found[r], np.int64)) for r in _RANKS]
    upper_limits = np.array([allowed(b, differ, PASS_UPPER) for b in range(65)], np.uint8)
    code_limit, most = allowed(64, differ, PASS_CODE), allowed(64 * TABLES, differ, PASS_ALL)

    def coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The rows' codes and their ranges, both by table."""
        ranks = np.stack([batch.column(1 + t).to_numpy() for t in range(TABLES)])
        raw = ranks.view(np.uint64) ^ _TOP
        return raw ^ (raw >> np.uint64(1)), np.stack([np.searchsorted(cuts[t], ranks[t]) for t in range(TABLES)]).astype(np.int64)

    def own_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, own = coded(batch)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[t]), t, np.int32)), pa.array(own[t]), pa.array(codes[t].view(np.int64))], ["t", "range", "code"])

    source = classes.select("node", *_RANKS)
    # One row for each of at most MOST_RANGES ranges of a table: the bits on which all its codes agree.
    nodes = source.mapInArrow(own_ranges, "t int, range long, code long").groupBy("t", "range").agg(F.bit_and("code").alias("all"), F.bit_or("code").alias("any")).toArrow()
    upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t in range(TABLES):
        mine = nodes.filter(pc.equal(nodes.column("t"), t))
        every, some = (mine.column(k).to_numpy().view(np.uint64) for k in ("all", "any"))
        upper.append((mine.column("range").to_numpy(), every, ~(every ^ some)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [GrayIndex(every & masks, masks) if len(every) else None for _, every, masks in upper]

        def rows(t: int, ranges: np.ndarray, which: np.ndarray, codes: np.ndarray, batch: pa.RecordBatch, visitor: bool) -> pa.RecordBatch:
            words = [pa.array(codes[k][which].view(np.int64)) for k in range(TABLES)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), t, np.int32)), pa.array(ranges), batch.column(0).take(pa.array(which)), *words, pa.array(np.full(len(which), visitor))], ["t", "range", "node", *_CODES, "visitor"])

        for batch in batches:
            codes, own = coded(batch)
            for t in range(TABLES):
                numbers = upper[t][0]
                yield rows(t, own[t], np.arange(batch.num_rows), codes, batch, False)
                for query, leaf in trees[t].search(codes[t], upper_limits):
                    to, at = numbers[leaf], own[t][query]
                    goes = (to != at) & ((at < to) == ((at + to) % 2 == 1))  # one direction for each pair of ranges
                    if goes.any():
                        yield rows(t, to[goes], query[goes], codes, batch, True)

    def search(rows: pa.Table) -> pa.Table:
        visitor = rows.column("visitor").to_numpy(zero_copy_only=False)
        order = np.argsort(visitor, kind="stable")
        node = rows.column("node").to_numpy()[order]
        codes = np.stack([rows.column(c).to_numpy()[order].view(np.uint64) for c in _CODES])
        size, found = int((~visitor).sum()), []
        own = codes[rows.column("t")[0].as_py()]
        step = max(1, (1 << 22) // max(1, size))
        for begin in range(0, len(node) if size else 0, step):
            q, m = np.nonzero(np.bitwise_count(own[begin : begin + step, None] ^ own[None, :size]) <= code_limit)
            q += begin
            q, m = q[q != m], m[q != m]
            apart = np.zeros(len(q), np.int64)
            for words in codes:
                apart += np.bitwise_count(words[q] ^ words[m])
            near = apart <= most
            q, m, apart = q[near], m[near], apart[near]
            if len(q):  # the nearest for each
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                m = np.minimum.reduceat(apart << 32 | m, first) & 0xFFFFFFFF
                q = q[first]
            found.append((q, m))
        q, m = (np.concatenate([f[i] for f in found]) if found else np.array([], np.int64) for i in range(2))
        a, b = np.minimum(node[q], node[m]), np.maximum(node[q], node[m])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ranged = source.mapInArrow(route, "t int, range long, node long, " + ", ".join(f"{c} long" for c in _CODES) + ", visitor boolean")
    return ranged.groupBy("t", "range").applyInArrow(search, "a long, b long").where("a < b").distinct()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, range_size: int = SIMILAR_RANGE) -> DataFrame:
    """For each row of df with an id: id_col and component_id, the smallest id of its group.

    Rows with equal sets of shingles are copies. Texts whose sets have a Jaccard similarity of `similarity` or more are
    linked, and links chain. Every link that is made has been checked on the sets; of the links that there are, the
    indexes find those that README.md states (a pair that is just similar is missed by each of TABLES indexes with
    a chance of about 0.4; more similar ones by far less). A text of fewer words than a shingle is one shingle; texts
    without words are copies of each other. Rows with a null id are left out; repeated rows and ids give a row each. Columns of
    df besides the two aren't carried over. An empty table gives none.
    """
    rows = write_shared(signatures(df.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, shingle, seed), "signatures")
    classes = write_shared(rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), *[F.min(r).alias(r) for r in _RANKS]), "classes")
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # from the cosine of two sets of equal size
    pairs = write_shared(proposals(classes, differ, range_size), "proposals")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = classes.join(needed, "node", "left_semi").select(F.col("least").alias("__least"))
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, F.col("id") == F.col("__least"), "left_semi")
    sets = write_shared(shingle_sets(texts, "id", "text", shingle, seed).join(needed, "node", "left_semi").dropDuplicates(["node"]), "sets")
    near = star_components(alike(pairs, sets, similarity), "near")
    open_sets = sets.join(near, "node", "left").join(classes, "node").select("node", "set", F.coalesce("root", "node").alias("comp"), *_RANKS)
    both = write_shared(rare_pairs(open_sets, similarity, allowed(64 * TABLES, differ, PASS_ALL)), "rare")
    stars = star_components(alike(both, sets, similarity).union(near.select(F.col("node").alias("a"), F.col("root").alias("b"))), "similar")
    joint = classes.join(stars, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    least = joint.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joint.join(least, "root").select(F.col("node").alias("own"), "n", "component_id")
    return labelled(rows, labels, "node").select(F.col("id").alias(id_col), "component_id")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, set) are similar."""
    a, b = (sets.select(F.col("node").alias(e), F.col("set").alias(f"set_{e}")) for e in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def rare_pairs(sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of sets (node, set, comp, r0 to r5) in different components that can be similar.

    Sets as similar as that share an element among the first n - ceil(similarity * n) + 1 of each, in any common order;
    the order here is from the rarest to the commonest, and what stands before a pair's first common element can't be
    common, nor may the fingerprints r0 to r5 differ in more than `most` bits. Elements that only one component has aren't paired.
    """
    each = sets.select("node", "comp", F.size("set").alias("n"), F.explode("set").alias("x"))
    held = each.groupBy("x").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    order = F.sort_array(F.collect_list(F.struct("df", "x", (F.col("low") < F.col("high")).alias("mixed"))))
    ordered = each.join(held, "x").groupBy("node", "comp", "n").agg(order.alias("xs"))
    rare = ordered.select("node", "comp", "n", F.posexplode(F.slice("xs", F.lit(1), first)).alias("before", "s")).where("s.mixed")
    rare = write_shared(rare.select("node", "comp", "n", "before", "s.x").join(sets.select("node", *_RANKS), "node"), "elements")
    a, b = (rare.select("x", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "comp", "n", "before", *_RANKS)]) for e in "ab")
    rest = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    fit = rest >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9
    # Gray codes' differences are the Gray code of the ranks' differences.
    differ = [F.col(f"{r}_a").bitwiseXOR(F.col(f"{r}_b")) for r in _RANKS]
    apart = sum((F.bit_count(d.bitwiseXOR(F.shiftrightunsigned(d, 1))) for d in differ), F.lit(0))
    return a.join(b, (a["x"] == b["x"]) & (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & fit & (apart <= most)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """df with one row of each group of similar_groups(): the one with the smallest id, with all its columns.

    A row that stands there several times stays once. Rows with a null id can't be told apart and all stay.
    """
    return _keep_first(df, similar_groups(df, id_col, text_col, shingle, similarity, seed), id_col)
