"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. Let U be the tokens that the merges really produce (encoding a token's own bytes gives the token). A
sequence of such tokens is the encoding of its bytes if and only if every adjacent pair is: merging the pair's
bytes on their own gives the pair back. So a text's encoding is the one path of a nondeterministic transducer
whose states are (last token, node of the trie of U) and which checks each pair as it closes a token. Transducer
makes that machine deterministic as it reads: a state is the set of live hypotheses, each with the tokens that
it has not emitted yet. What all hypotheses agree on is emitted at once, so the lookahead is bounded by the
longest token. States and transitions are kept in a cache of a fixed size. When it is full, what it doesn't hold
is worked out on the way, without being kept; it starts afresh once that has become frequent.

Decoding. Utf8Stream keeps the state of a UTF-8 machine between chunks of ids: a character that is cut by the
end of a chunk waits for its remaining bytes; malformed bytes become U+FFFD, one for each maximal part.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from recallgrid.llm.common import freeing, texts_of

#: Limits of the caches in a Python worker. They bound memory, not results: some 70 MB, which end with the task.
MOST_STATES = 40_000
MOST_PIECES = 150_000
#: Where nothing else runs in the worker, four times that, kept from task to task.
ALONE = 4
LONGEST_KEPT = 64
#: A full cache starts afresh after so many misses for each of its entries.
PATIENCE = 20

_NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: a line has a token in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of the lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes the bytes of one pre-token by the compiled merges."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.most_states = most_states
        self.wide = max(ranks.values()).bit_length()
        # The trie: (node << 8 | byte) -> node; ends[node] is the id of the token that ends there, open[node] whether it goes on.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.open: list[bool] = [False]
        # (left id << wide | right id) -> id, wherever two tokens' bytes make a third
        self.joined: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.child.get(node << 8 | byte)
                if step is None:
                    step = self.child[node << 8 | byte] = len(self.ends)
                    self.open[node] = True
                    self.ends.append(-1)
                    self.open.append(False)
                node = step
            self.ends[node] = rank
            for i in range(1, len(token)):
                x = ranks.get(token[:i])
                if x is not None and (y := ranks.get(token[i:])) is not None:
                    self.joined[x << self.wide | y] = rank
        self.halves: dict[int, tuple[int, int] | None] = {t: (t, t) for d, t in ranks.items() if len(d) == 1}
        self.ranks = ranks
        self.pair_ok: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: hypotheses (last token, tokens not emitted yet, trie node). States are numbered; number 0 is the start.
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}
        self.missed = 0
        self._state(((-1, (), 0),))

    def _state(self, hypotheses: tuple) -> int:
        n = self.number.get(hypotheses)
        if n is None:
            n = self.number[hypotheses] = len(self.states)
            self.states.append(hypotheses)
        return n

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; itself twice for a byte; None if the merges never make it."""
        try:
            return self.halves[token]
        except KeyError:
            data, ranks, made = self.bytes_of[token], self.ranks, None
            for i in range(1, len(data)):
                x, y = ranks.get(data[:i], _NEVER), ranks.get(data[i:], _NEVER)
                if x < token and y < token and self._halves(x) and self._halves(y) and self._apart(x, y, token):
                    made = (x, y)
                    break
            self.halves[token] = made
            return made

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether merges of ranks below until, applied to the bytes of two tokens together, leave the two apart.

        Both are undone step by step, the later merge first. They stay apart unless, at some moment of the
        merging, the parts that meet at the border make a token before either part is used up: the border parts
        exist together until the earlier of the merges that consume them, left before right on equal ranks.
        """
        joined, halves, wide = self.joined.get, self.halves, self.wide
        left_until = right_until = until
        while True:
            met = joined(left << wide | right, _NEVER)
            if met < left_until and met <= right_until and met != until:
                return False
            x, y = halves[left], halves[right]
            if x[0] == left:
                if y[0] == right:
                    return True
                right_until, right = right, y[0]
            elif y[0] == right or left >= right:
                left_until, left = left, x[1]
            else:
                right_until, right = right, y[0]

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together gives a and b."""
        key = a << self.wide | b
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) > 4 * self.most_states:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self._apart(a, b, _NEVER)
        return ok

    def _step(self, hypotheses: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """What a byte makes of a state, and the tokens emitted. Hypotheses stand in the order in which their open tokens begin."""
        child, ends, goes_on, after, closed = self.child.get, self.ends, self.open, [], None
        for last, held, node in hypotheses:
            to = child(node << 8 | byte)
            if to is None:
                continue
            if closed is None:  # the encoding of what is read so far is unique: one hypothesis at most can close here
                token = ends[to]
                if token >= 0 and self._halves(token) and (last < 0 or self._adjacent(last, token)):
                    closed = (token, (*held, token), 0)
            if goes_on[to]:
                after.append((last, held, to))
        if closed:
            after.append(closed)
        if not after:
            return (), ()
        agreed = after[0][1]
        if agreed:
            for other in after:
                if agreed != other[1]:
                    n = 0
                    for x, y in zip(agreed, other[1], strict=False):
                        if x != y:
                            break
                        n += 1
                    agreed = agreed[:n]
                    if not n:
                        break
            if agreed:
                n = len(agreed)
                after = [(last, held[n:], node) for last, held, node in after]
        return tuple(after), agreed

    def _final(self, hypotheses: tuple, piece: bytes) -> tuple[int, ...]:
        ends = [held for _, held, node in hypotheses if node == 0]
        if len(ends) != 1:
            raise ValueError(f"the merges don't give one encoding but {len(ends)} of {piece[:80]!r}")
        return ends[0]

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        out: list[int] = []
        state, steps = 0, self.steps
        for at, byte in enumerate(piece):
            step = steps.get(state << 8 | byte)
            if step is None:
                if len(self.states) >= self.most_states:
                    return self._encode_rest(piece, at, state, out)
                after, agreed = self._step(self.states[state], byte)
                step = steps[state << 8 | byte] = (self._state(after), agreed)
            state, emitted = step
            if emitted:
                out += emitted
        final = self.finals.get(state)
        if final is None:
            final = self.finals[state] = self._final(self.states[state], piece)
        out += final
        return out

    def _encode_rest(self, piece: bytes, at: int, state: int, out: list[int]) -> list[int]:
        """Goes on from a place for which the full cache has no step; where a known state is met, by its steps."""
        steps, states, number = self.steps, self.states, self.number
        hypotheses, known = states[state], state
        for byte in piece[at:] if at else piece:
            step = steps.get(known << 8 | byte) if known is not None else None
            if step is None:
                hypotheses, emitted = self._step(hypotheses, byte)
                known = number.get(hypotheses)
                self.missed += 1
            else:
                known, emitted = step
                hypotheses = states[known]
            if emitted:
                out += emitted
        out += self._final(hypotheses, piece)
        if self.missed > PATIENCE * self.most_states:
            self._clear()
        return out


class Encoder:
    """Encodes texts: pre-tokens by a pattern, each by the transducer, with a bounded cache of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = MOST_PIECES, most_states: int = MOST_STATES):
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, most_states)
        self.most_pieces = most_pieces
        self.code = "H" if max(ranks.values()) < 1 << 16 else "I"
        self.kept: dict[str, bytes] = {}
        self.missed = 0

    def packed(self, text: str) -> bytes:
        """The text's ids, each in the machine's form of type code self.code."""
        pieces = self.find(text)
        kept, encode, code = self.kept, self.transducer.encode, self.code
        new = set(pieces).difference(kept)
        if not new:
            return b"".join(map(kept.__getitem__, pieces))
        room = self.most_pieces - len(kept)
        own: dict[str, bytes] = {}
        for piece in new:
            ids = array(code, encode(piece.encode("utf-8"))).tobytes()
            if room > 0 and len(piece) <= LONGEST_KEPT:
                kept[piece] = ids
                room -= 1
            else:
                own[piece] = ids
        if not own:
            return b"".join(map(kept.__getitem__, pieces))
        found = b"".join([kept[p] if p in kept else own[p] for p in pieces])
        if room <= 0:
            self.missed += len(own)
            if self.missed > PATIENCE * self.most_pieces:
                kept.clear()
                self.missed = 0
        return found

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast(self.code).tolist()


class Utf8Stream:
    """Turns ids into text, chunk by chunk."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete: the machine's state after data."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
                if back >= need:
                    return 0
                if back > 1:  # the second byte's range is narrower after these leads
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                    if not low <= data[1 - back] <= high:
                        return 0
                return back
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self.unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def decode(ids: list[int], bytes_of: dict[int, bytes], chunk: int = 65_536) -> str:
    stream = Utf8Stream(bytes_of)
    return "".join([*(stream.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)), stream.close()])


_encoders: dict[tuple[str, str], Encoder] = {}


def _kept_encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern, ALONE * MOST_PIECES, ALONE * MOST_STATES)
    return _encoders[path, pattern]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """df with ids_col, array<int>: the ids of each whole text; a null text counts as empty and gives no ids.

    With check_col, a boolean of that name says whether decoding the ids gives the text back; both ways are one pass.
    Works row by row, so repeated rows, ties and an empty table need no rule. Columns of df that are called
    ids_col or check_col are replaced; all others stay as they are.
    """
    kept = [c for c in df.columns if c not in (ids_col, check_col)]
    source = df.select(*[f"`{c}`" for c in kept])
    schema = StructType(list(source.schema.fields)).add(ids_col, ArrayType(IntegerType()))
    if check_col:
        schema = schema.add(check_col, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(ranks_path), pattern)
        bytes_of = encoder.transducer.bytes_of
        for part in _slices(batches):
            texts = texts_of(part.column(kept.index(text_col)))
            coded = [np.frombuffer(encoder.packed(t), encoder.code) for t in texts]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            out = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32)))]
            if check_col:
                out.append(pa.array([decode(ids.tolist(), bytes_of) == t for ids, t in zip(coded, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return source.mapInArrow(freeing(run), schema)


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text of ids_col; null or no ids give an empty text. A column called out_col is replaced."""
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: t for t, i in load_ranks(ranks_path).items()}
        for part in _slices(batches):
            texts = [decode(ids or [], bytes_of) for ids in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(freeing(run), schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256.

    The ids are encoded by the transducer and decoded by the stream, in one pass, so that ids of large tables
    need not pass between processes. Null texts count as empty: no ids, digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept_encoder(ranks_path, pattern)
        bytes_of = encoder.transducer.bytes_of
        decimal = {i: str(i) for i in bytes_of}
        for batch in _slices(batches):
            n, coded, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(decode(ids, bytes_of).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
