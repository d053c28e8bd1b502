"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy, in bands.

A public sentencepiece vocabulary encodes every word of a text. Ordinary prose of a language has a narrow range of
characters per token and of token entropy at a given length; boiler-plate, symbol noise and mistaken encodings fall
outside. The bands are the corpus's own: for each language, each script and all rows, at each power of two of tokens
and over all lengths, the quartiles of all rows, widened by `reach` interquartile ranges and by a least width. A
row is held against the narrowest of these groups that has enough rows, at last against the corpus, so that every row is
judged. Quartiles come from mergeable sketches over every row; the table of bands has at most MOST_BANDS rows and is
broadcast.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import freeing, write_shared

#: Scripts by the code points of their letters.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ", "devanagari": "ऀ-ॿ",
    "thai": "฀-๿", "hangul": "가-힯ᄀ-ᇿ", "kana": "぀-ヿ", "han": "一-鿿㐀-䶿",
}
#: Two letters each, or a script, or none, or all; times a power of two up to 2**40, or all.
MOST_BANDS = (26 * 26 + len(SCRIPTS) + 2) * 43
#: Groups from the narrowest to the corpus.
LEVELS = (("key", "size"), ("script", "size"), ("everything", "size"), ("key", "any"), ("script", "any"), ("everything", "any"))
#: Bytes of words and token ids that a Python worker keeps between batches; it bounds memory, not results.
MOST_KEPT = 48 << 20
#: The least width of a band to either side of the quartiles.
LEAST_WIDTH = {"chars_per_token": 0.1, "byte_share": 0.05, "entropy": 0.25}
SYMBOLS = "#*$%&|<>"

_ranges = sorted((ord(chars[i]), ord(chars[i + 2]), number) for number, chars in enumerate(SCRIPTS.values()) for i in range(0, len(chars), 3))
_first, _last, _number = (np.array(x) for x in zip(*_ranges, strict=True))


def script(text: str) -> str:
    """The script of most letters; ties go to the first in SCRIPTS; 'none' without any."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return "none"
    seen = np.bincount(codes, minlength=1) if len(codes) > 1 << 16 else None
    codes, times = (np.flatnonzero(seen), seen[seen > 0]) if seen is not None else np.unique(codes, return_counts=True)
    at = np.searchsorted(_first, codes, side="right") - 1
    inside = (at >= 0) & (codes <= _last[at])
    counts = np.bincount(_number[at[inside]], weights=times[inside], minlength=len(SCRIPTS))
    best = int(counts.argmax())
    return list(SCRIPTS)[best] if counts[best] else "none"


class Vocabulary:
    """Encodes words, each on its own, keeping those that it has seen."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.code = "H" if n <= 1 << 16 else "I"
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(n)])
        self.kept: dict[bytes, bytes] = {}
        self.size = 0

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text (its words), the ids of all its tokens."""
        if self.size > MOST_KEPT:
            self.kept, self.size = {}, 0
        kept = self.kept
        new = list({w for words in texts for w in words if w not in kept})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for word, ids in zip(part, self.model.encode([w.decode("utf-8") for w in part], num_threads=1), strict=True):
                kept[word] = array(self.code, ids).tobytes()
                self.size += 120 + len(word) + len(kept[word])
        return [np.frombuffer(b"".join(map(kept.__getitem__, words)), self.code) for words in texts]


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words lie in runs of `window` words that occur twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):  # equal windows have equal sums, so that distinct sums settle it
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    if len(np.unique(mixed)) == n:
        return 0
    rank, size = ids, 1
    while size < window:  # exact ranks of windows of twice the size, from pairs of ranks
        step = min(size, window - size)
        m = len(rank) - step
        rank = np.unique(rank[:m] * (rank.max() + 1) + rank[step : step + m], return_inverse=True)[1]
        size += step
    twice = np.bincount(rank)[rank] >= 2
    return int((np.convolve(twice, np.ones(window, np.int64)) > 0).sum())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def entropy(ids: np.ndarray) -> float:
    """Bits a token, of the distribution of a text's tokens."""
    if not len(ids):
        return 0.0
    counts = np.unique(ids, return_counts=True)[1] if len(ids) < 4096 else (c := np.bincount(ids))[c > 0]
    p = counts / len(ids)
    return float(-(p * np.log2(p)).sum())


def measure(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """For each row: its id, the base counts, n_tokens, chars_per_token, byte_share, entropy, and its groups: key (language, or script), script, size."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "key", "script", "size"]
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in df.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(vocabulary_path)
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                words = [t.encode("utf-8").split() for t in texts]
                rows = []
                for text, own, ids, spoken in zip(texts, words, vocabulary.ids(words), batch.column(2).to_pylist(), strict=True):
                    lines = [x for x in text.encode("utf-8").split(b"\n") if x.strip()]
                    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
                    n, chars = len(ids), len(text) - spaces
                    letters = "script " + script(text)
                    key = spoken if spoken and re.fullmatch("[a-z]{2}", spoken) else letters
                    rows.append((
                        len(own), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(own), n,
                        chars / n if n else 0.0, float(vocabulary.is_byte[ids].mean()) if n else 0.0, entropy(ids), key, letters, n.bit_length(),
                    ))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64() if i in (6, 7, 8) else pa.string() if i in (9, 10) else pa.int64()) for i, c in enumerate(columns))], names)

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, key string, script string, size long"
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang")).mapInArrow(freeing(run), schema)


def _groups() -> list:
    """The row's group at each level: number of the level, key, size."""
    at = {"key": F.col("key"), "script": F.col("script"), "everything": F.lit("all"), "size": F.col("size"), "any": F.lit(-1).cast("long")}
    return [F.struct(F.lit(i).alias("level"), at[of].alias("of"), at[length].alias("length")) for i, (of, length) in enumerate(LEVELS)]


def bands(measured: DataFrame, reach: float = 3.0, least_rows: int = 40, accuracy: int = 2000) -> DataFrame:
    """For each group of LEVELS with least_rows rows (the corpus: with any): level, of, length, lo_ and hi_ of each measure."""
    judged = measured.where("n_tokens > 0").select(F.explode(F.array(*_groups())).alias("g"), *LEAST_WIDTH).select("g.*", *LEAST_WIDTH)
    found = [F.count("*").alias("rows"), *[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy)).alias(m) for m in LEAST_WIDTH]]
    limits = []
    for m, least in LEAST_WIDTH.items():
        width = F.greatest((F.col(m)[1] - F.col(m)[0]) * reach, F.lit(least))
        limits += [(F.col(m)[0] - width).alias(f"lo_{m}"), (F.col(m)[1] + width).alias(f"hi_{m}")]
    quartiles = judged.groupBy("level", "of", "length").agg(*found)
    return quartiles.where((F.col("rows") >= least_rows) | (F.col("level") == len(LEVELS) - 1)).select("level", "of", "length", *limits)


def judge(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", reach: float = 3.0, min_words: int = 20, most_repeated: int = 30, least_rows: int = 40) -> DataFrame:
    """For each row of df: id_col, the base counts, base_failed, kept, and the three measures.

    base_failed: fewer than min_words words, or over most_repeated per cent of the words in repeated windows of 8.
    kept: not base_failed, and each measure within the band of the row's narrowest group that has least_rows rows: its
    language at its length, its script at its length, all rows of its length, then these three over all lengths, the
    last of them with any number of rows. Words are runs other than ASCII white space; a null or empty text has none
    and fails. A language counts if it is two small letters, else the text's script stands in. Repeated rows and ids
    give a row each; other columns of df aren't carried over; an empty table gives none.
    """
    measured = write_shared(measure(df, vocabulary_path, id_col, text_col, lang_col), "fertility")
    limits = write_shared(bands(measured, reach, least_rows), "bands")  # MOST_BANDS rows at most
    # The groups that rows really have, each with the first of its levels that has a band: no more than there are bands.
    names = [c for c in limits.columns if c[:3] in ("lo_", "hi_")]
    groups = measured.select("key", "script", "size").distinct()
    each = groups.select("*", F.explode(F.array(*_groups())).alias("g")).select("key", "script", "size", "g.*")
    first = each.join(F.broadcast(limits), ["level", "of", "length"]).groupBy("key", "script", "size").agg(*[F.min_by(c, "level").alias(c) for c in names])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    inside = F.lit(True)
    for m in LEAST_WIDTH:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    own = F.broadcast(write_shared(first, "groups"))  # a language, a script and a size: MOST_BANDS times the scripts at most
    return measured.join(own, ["key", "script", "size"], "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", F.col("entropy").alias("token_entropy"),
    )
