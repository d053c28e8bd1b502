"""Token counts without token ids: each distinct pre-token is counted once, then summed over documents.

1. Documents are read in blocks of about block_chars characters. A block gives its sorted distinct pre-tokens
   and, for each document, the numbers of its pre-tokens in that list with their frequencies, packed. This table
   is written to the shared folder: later steps don't depend on reading the documents in the same order again.
2. The blocks' pre-tokens meet by value, sorted, so that a pre-token's pieces are counted once wherever it occurs.
3. The counts go back to their blocks, packed likewise, and join the documents' frequencies there; a document's sum is one dot product.

What is shuffled is a row for each distinct pre-token of a block and a packed row for each document, never a row
for each word. A pre-token that every document has is one row a block.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from recallgrid.llm.common import write_shared

#: Counts that a task holds before it hands them back to their blocks, packed.
HELD_COUNTS = 1_000_000
#: Characters whose class, case and composition are the same in any version of Unicode.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]")


class PreTokens:
    """A tokenizers file's pre-tokens of a text, and the number of pieces of each."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.find = self.split = None
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and "Regex" in parts[0]["pattern"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
            if steps == ["NFC", "Replace", "Lowercase"]:
                self.find = regex.compile(parts[0]["pattern"]["Regex"]).findall
                self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _segment(self, text: str) -> list[str]:
        if not text:
            return []
        if self.find is not None:
            if text.isascii() and not _UNUSUAL.search(text):
                return self.find(text.lower())
            if not _UNUSUAL.search(text):
                return self.find(unicodedata.normalize("NFC", text).lower())
            text = self.tokenizer.normalizer.normalize_str(text)
            if not _UNUSUAL.search(text):
                return self.find(text)
            if self.split is None:
                from tokenizers import Regex

                self.split = pre_tokenizers.Split(Regex(self.find.__self__.pattern), "removed", invert=True)
            return [p for p, _ in self.split.pre_tokenize_str(text)]
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many added tokens stand in the text: the library takes these out first."""
        if self.added is None or not self.added.search(text):
            return self._segment(text), 0
        found: list[str] = []
        n = start = 0
        for m in self.added.finditer(text):
            found += self._segment(text[start : m.start()])
            start, n = m.end(), n + 1
        return found + self._segment(text[start:]), n

    def pieces(self, pre_token: str) -> int:
        if self.find is not None:
            return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in self.byte_level.pre_tokenize_str(pre_token))
        return len(self.tokenizer.model.tokenize(pre_token))


_loaded: dict[str, PreTokens] = {}


def _pre_tokens(path: str) -> PreTokens:
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def pack(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers as gaps, and frequencies, each in the narrowest type; unpack() reverses it."""
    gaps = np.diff(numbers, prepend=0)
    kinds = [2 if gaps.size == 0 or gaps.max() < 1 << 16 else 4, 1 if times.size == 0 or times.max() < 1 << 8 else 4]
    return bytes(kinds) + zlib.compress(gaps.astype(f"<u{kinds[0]}").tobytes() + times.astype(f"<u{kinds[1]}").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = packed[0], packed[1]
    data = zlib.decompress(packed[2:])
    n = len(data) // (a + b)
    return np.cumsum(np.frombuffer(data, f"<u{a}", n).astype(np.int64)), np.frombuffer(data, f"<u{b}", n, n * a).astype(np.int64)


class _Block:
    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, doc_id, text: str, model: PreTokens) -> None:
        found, extra = model.of(text)
        number = self.numbers.setdefault
        numbers = self.numbers
        ids, times = np.unique(np.fromiter((number(p, len(numbers)) for p in found), np.int64, len(found)), return_counts=True)
        self.rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")), extra, ids.astype(np.int32), times.astype(np.int32)))
        self.chars += len(text)

    def batch(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        words = sorted(self.numbers)
        at = np.empty(len(words), np.int64)
        at[np.fromiter((self.numbers[w] for w in words), np.int64, len(words))] = np.arange(len(words))
        packed = []
        for _, _, _, ids, times in self.rows:
            new = at[ids]
            order = np.argsort(new, kind="stable")
            packed.append(pack(new[order], times[order]))
        n = len(self.rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array([r[0] for r in self.rows], schema.field(1).type), pa.array([r[1] for r in self.rows], pa.int64()), pa.array([r[2] for r in self.rows], pa.int64()), pa.array(packed, pa.binary()), pa.array([None] * n, pa.list_(pa.string()))],
            schema=schema,
        )
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None], schema.field(1).type), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.array([words], pa.list_(pa.string()))], schema=schema)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 12_000_000) -> DataFrame:
    """For each row of df: id_col, n_bytes (of the text in UTF-8) and n_tokens, as the tokenizers library gives them.

    Without begin, end or added special tokens, truncation or padding; an added token's string inside a text is
    that token, as is the library's default. A null text counts as empty: no bytes, no tokens. Repeated rows and
    repeated or null ids give a row each; other columns of df aren't carried over. An empty table gives none.
    """
    kind = df.schema[id_col].dataType
    arrow_id = df.select(f"`{id_col}`").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("block", pa.int64()), ("id", arrow_id), ("n_bytes", pa.int64()), ("extra", pa.int64()), ("packed", pa.binary()), ("words", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, n = _pre_tokens(tokenizer_path), _Block(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text or "", model)
                if block.chars >= block_chars:
                    yield from block.batch(part << 24 | n, schema)
                    block, n = _Block(), n + 1
        if block.rows:
            yield from block.batch(part << 24 | n, schema)

    packed = write_shared(
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(read, f"block long, id {kind.simpleString()}, n_bytes long, extra long, packed binary, words array<string>"),
        "pretokens",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, n = _pre_tokens(tokenizer_path), None, 0
        held: list[tuple[np.ndarray, np.ndarray, list[int]]] = []

        def packed_by_block() -> pa.RecordBatch:
            blocks, numbers, counts = (np.concatenate([np.asarray(h[i]) for h in held]) for i in range(3))
            order = np.lexsort((numbers, blocks))
            own, start = np.unique(blocks[order], return_index=True)
            ends = np.append(start[1:], len(order))
            rows = [pack(numbers[order[x:y]].astype(np.int64), counts[order[x:y]]) for x, y in zip(start, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.binary())], ["block", "counts"])

        for batch in batches:
            counts = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, n = word, model.pieces(word)
                counts.append(n)
            if counts:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts))
            if sum(len(h[2]) for h in held) >= HELD_COUNTS:
                yield packed_by_block()
                held.clear()
        if held:
            yield packed_by_block()

    words = packed.where("words is not null").select("block", F.posexplode("words").alias("number", "word"))
    counted = words.repartition("word").sortWithinPartitions("word").mapInArrow(count, "block long, counts binary")

    def total(rows: pa.Table, counts: pa.Table) -> pa.Table:
        found = [unpack(c) for c in counts.column("counts").to_pylist()]
        each = np.zeros(1 + max((int(numbers[-1]) for numbers, _ in found), default=0), np.int64)
        for numbers, n in found:
            each[numbers] = n
        sums = []
        for data, extra in zip(rows.column("packed").to_pylist(), rows.column("extra").to_pylist(), strict=True):
            numbers, times = unpack(data)
            sums.append(int(each[numbers] @ times) + extra)
        return pa.table([rows.column("id"), rows.column("n_bytes"), pa.array(sums, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    documents = packed.where("packed is not null").select("block", "id", "n_bytes", "extra", "packed")
    return documents.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(total, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long")
