"""Line deduplication by a sharded minimal perfect hash over distinct line hashes.

Documents are dealt out to blocks. A block lists the distinct line hashes that it holds, each with the number of its
documents and its largest document id. line_index() merges the lists shard by shard of the hash space: a shard is a
minimal perfect hash over its distinct hashes and three compact arrays at the hash's slots: a fingerprint, a count that
stops at 255, and the owner (the largest id). drop_repeated() sends documents' hashes to the shards, where they
probe these arrays; only the lines that are repeated return to their block, which drops them from its documents. Documents may
probe an index of other documents: the fingerprint tells a line that was not built in.

So lines are never joined one by one, a line that is in every document is one entry a block, and the memory of a
shard is about 40 bytes for each of its lines. Blocks and shards grow in number with the data, not in size.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallgrid.llm.common import INT64_MIN, block_of, count_for, unused_name

#: Bytes of input for a block and for a shard.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 8 << 20


class MinimalPerfectHash:
    """Levels of bit arrays: a key that is alone at its place of a level sets the bit; the others go to the next level.

    A key's slot is the number of bits set before its own. Keys that no level of LEVELS has settled keep a sorted list.
    """

    LEVELS = 24
    GAMMA = 2

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # bits, ones before each 64, size
        n, left = 0, np.arange(len(hi))
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = max(64, -(-len(left) * self.GAMMA // 64) * 64)
            place = self._place(hi[left], lo[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, n + np.cumsum(ones) - ones, size))
            n += int(ones.sum())
            left = left[~alone[place]]
        rest = np.sort(hi[left] ^ (lo[left] * np.uint64(0x9E3779B97F4A7C15)))
        self.rest, self.first_rest = rest, n
        self.size = n + len(rest)

    @classmethod
    def of(cls, bits: list[np.ndarray], rest: np.ndarray) -> MinimalPerfectHash:
        """From the levels' bits and the hashes that no level has settled."""
        made, n = cls.__new__(cls), 0
        made.levels = []
        for words in bits:
            ones = np.bitwise_count(words).astype(np.int64)
            made.levels.append((words, n + np.cumsum(ones) - ones, 64 * len(words)))
            n += int(ones.sum())
        made.rest, made.first_rest, made.size = rest, n, n + len(rest)
        return made

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hi + lo * np.uint64(2 * level + 1) + np.uint64(level)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Each key's slot, 0 to size - 1; keys that weren't built in get any slot or -1."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (words, before, size) in enumerate(self.levels):
            place = self._place(hi[left], lo[left], level, size)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = before[place[found] >> 6] + below[found]
            left = left[~found]
            if not len(left):
                return out
        if len(self.rest):
            key = hi[left] ^ (lo[left] * np.uint64(0x9E3779B97F4A7C15))
            at = np.searchsorted(self.rest, key).clip(max=len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == key, self.first_rest + at, -1)
        return out


class LineIndex:
    """A shard: the minimal perfect hash and, at its slots, fingerprints, counts up to 255 and owners."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, owner: np.ndarray):
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        start = np.flatnonzero(new)
        hi, lo = hi[start], lo[start]
        counts, owners = (np.add.reduceat(n[order].astype(np.int64), start), np.maximum.reduceat(owner[order], start)) if len(start) else (start, start)
        self.hash = MinimalPerfectHash(hi, lo)
        slot = self.hash.slots(hi, lo)
        self.fingerprints, self.counts, self.owners = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint8), np.zeros(len(hi), np.int64)
        self.fingerprints[slot], self.counts[slot], self.owners[slot] = lo, np.minimum(counts, 255), owners

    def probe(self, hi: np.ndarray, lo: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in at least `least` documents, and the owners of all (meaningful where they are)."""
        if not self.hash.size:
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        slot = self.hash.slots(hi, lo)
        known = slot >= 0
        slot[~known] = 0
        return known & (self.fingerprints[slot] == lo) & (self.counts[slot] >= least), self.owners[slot]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = {f"level{i}": words for i, (words, _, _) in enumerate(self.hash.levels)}
        np.savez(out, rest=self.hash.rest, fingerprints=self.fingerprints, counts=self.counts, owners=self.owners, **levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        with np.load(io.BytesIO(data)) as found:
            index = cls.__new__(cls)
            index.hash = MinimalPerfectHash.of([found[f"level{i}"] for i in range(sum(name.startswith("level") for name in found.files))], found["rest"])
            index.fingerprints, index.counts, index.owners = found["fingerprints"], found["counts"], found["owners"]
        return index


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key: white space at both ends stripped, A-Z lower-cased; None if it is too short.

    On bytes, strip() and lower() know just the six ASCII white spaces and A-Z.
    """
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    return [line_key(line, min_chars) for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _lists(df: DataFrame, id_col: str, text_col: str, min_chars: int, block: str, shards: int) -> DataFrame:
    """block, shard, hi, lo (a line's hash), n and owner: one row for each distinct line of a block."""
    shift = np.uint64(65 - shards.bit_length())

    def collect(key: tuple, rows: pa.Table) -> pa.Table:
        held: dict[bytes, list[int]] = {}
        for doc_id, text in zip(rows.column(id_col).to_pylist(), rows.column(text_col).to_pylist(), strict=True):
            own = INT64_MIN if doc_id is None else doc_id
            for k in set(_keys_of(text, min_chars)):
                if k is not None:
                    entry = held.get(k)
                    if entry is None:
                        held[k] = [1, own]
                    else:
                        entry[0] += 1
                        if own > entry[1]:
                            entry[1] = own
        both = np.frombuffer(b"".join(held), ">u8").reshape(-1, 2).astype(np.uint64)
        hi, lo = both[:, 0].copy(), both[:, 1].copy()
        shard = (hi >> shift).astype(np.int32) if shards > 1 else np.zeros(len(hi), np.int32)
        return pa.table({
            "block": pa.array(np.full(len(hi), key[0].as_py(), np.int32)), "shard": pa.array(shard), "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)),
            "n": pa.array([e[0] for e in held.values()], pa.int32()), "owner": pa.array([e[1] for e in held.values()], pa.int64()),
        })

    return df.groupBy(block).applyInArrow(collect, "block int, shard int, hi long, lo long, n int, owner long")


def _hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("hi").to_numpy().view(np.uint64), rows.column("lo").to_numpy().view(np.uint64)


def _merged(lists: DataFrame) -> DataFrame:
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        index = LineIndex(*_hashes(rows), rows.column("n").to_numpy(), rows.column("owner").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([index.to_bytes()], pa.binary())})

    return lists.groupBy("shard").applyInArrow(build, "shard int, index binary")


def shards_for(df: DataFrame, bytes_each: int = SHARD_BYTES) -> int:
    """A power of two of shards, so that each indexes the lines of about bytes_each of input."""
    return 1 << (count_for(df, bytes_each, 32, 1 << 30) - 1).bit_length()


def _blocks(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    block = unused_name(df, "block")
    return df.withColumn(block, block_of(count_for(df, BLOCK_BYTES, 48, 1 << 30), id_col, text_col)), block


def line_index(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """shard and index (a LineIndex in bytes) of df's lines of min_chars code points or more; shards is a power of two.

    Nulls, repeated rows and the key of a line: see dedup_lines(). An empty table gives no shards.
    """
    docs, block = _blocks(df, id_col, text_col)
    return _merged(_lists(docs, id_col, text_col, min_chars, block, shards))


def drop_repeated(df: DataFrame, index: DataFrame | None, shards: int, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df without the lines that min_docs documents of the index have, but for those that its largest id has.

    index is a line_index() with the same shards and min_chars, of df itself if None. Lines that it lacks stay.
    Columns and odd rows: see dedup_lines().
    """
    if not 2 <= min_docs <= 255:
        raise ValueError("min_docs: 2 to 255")
    source = df.drop("n_lines", "n_dropped")
    columns = source.columns
    docs, block = _blocks(source, id_col, text_col)
    lists = _lists(docs, id_col, text_col, min_chars, block, shards)

    def probe(hashes: pa.Table, shard: pa.Table) -> pa.Table:
        hi, lo = _hashes(hashes)
        found, owners = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        if len(hi) and shard.num_rows:
            found, owners = LineIndex.from_bytes(shard.column("index")[0].as_py()).probe(hi, lo, min_docs)
        return pa.table({"block": hashes.column("block").filter(pa.array(found)), "hi": pa.array(hi[found].view(np.int64)), "lo": pa.array(lo[found].view(np.int64)), "owner": pa.array(owners[found])})

    def rewrite(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hi, lo = _hashes(answers)
        both = np.stack([hi, lo], 1).astype(">u8").tobytes()
        owner_of = {both[16 * i : 16 * i + 16]: owner for i, owner in enumerate(answers.column("owner").to_pylist())}
        texts, n_lines, n_dropped = [], [], []
        for doc_id, text in zip(rows.column(id_col).to_pylist(), rows.column(text_col).to_pylist(), strict=True):
            own = INT64_MIN if doc_id is None else doc_id
            lines = (text or "").split("\n")
            kept = [line for line, k in zip(lines, _keys_of(text, min_chars), strict=True) if k is None or owner_of.get(k, own) == own]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        out = {c: rows.column(c) for c in columns} | {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        return pa.table(out)

    built = _merged(lists) if index is None else index  # all columns of the lists go to both, so that one exchange serves them
    answers = lists.groupBy("shard").cogroup(built.groupBy("shard")).applyInArrow(probe, "block int, hi long, lo long, owner long")
    schema = StructType(list(source.schema.fields)).add("n_lines", "long").add("n_dropped", "long")
    return docs.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(rewrite, schema)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with text_col rewritten, n_lines (before) and n_dropped.

    Lines are split at \\n; a key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of
    min_chars code points or more that min_docs (at most 255) rows hold lose all their lines except in the row
    with the largest id among them; the others stay in order, joined by \\n. A null text is one empty line and
    becomes an empty text. Rows that share the largest id all keep the line; a null id is below all others, and
    if all holders' ids are null, all keep it. Every row counts as a document of its own, repeated ones too. Other
    columns stay, except that columns called n_lines and n_dropped are replaced. An empty table gives an empty one.
    """
    return drop_repeated(df, None, shards_for(df), id_col, text_col, min_chars, min_docs)


def line_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of dedup_lines(): id_col, n_lines, n_dropped and kept_sha256 of the text that stays."""
    return df.select(f"`{id_col}`", "n_lines", "n_dropped", F.sha2(F.col(f"`{text_col}`").cast("binary"), 256).alias("kept_sha256"))
