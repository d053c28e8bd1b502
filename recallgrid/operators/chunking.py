"""Cutting texts into drawers: characters, exchanges, paragraphs, sessions; closets as pointers to drawers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the data model.
SIZE, OVERLAP, LEAST = 800, 100, 50
LEAST_EXCHANGE, REPLY_LINES, LINES_OF_A_GROUP = 30, 8, 25
CLOSET_CHARS, CLOSET_WINDOW = 1500, 5000


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Pieces of `size` characters that overlap, ending at a paragraph, or else a line, in their second half."""
    text, pieces, start = text.strip(), [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at
                    break
        piece = text[start:end].strip()
        if len(piece) >= least:
            pieces.append(piece)
        start = end - overlap if end < len(text) else len(text)
    return pieces


def chunk_characters(docs: DataFrame, key: str, text_col: str = "document", **sizes) -> DataFrame:
    """key, chunk_index, content. Where a piece ends depends on where the last one did, so a row is one loop."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [(k, i, c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, c in enumerate(cut(t or "", **sizes))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], part.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "chunk_index", "content"])

    return docs.select(key, text_col).mapInArrow(run, f"{key} {kind}, chunk_index int, content string")


def _stripped(part: Column) -> Column:
    return F.regexp_replace(part, r"^\s+|\s+$", "")


def paragraphs(docs: DataFrame, key: str, text_col: str = "document", least: int = LEAST_EXCHANGE) -> DataFrame:
    """key, chunk_index, content of more than `least` characters: paragraphs, or groups of 25 lines where there is one paragraph of over 20 line ends."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.filter(F.transform(F.split(text, "\n\n"), _stripped), lambda p: p != "")
    lines = F.split(text, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_OF_A_GROUP).cast("int")), lambda g: _stripped(F.array_join(F.slice(lines, g * LINES_OF_A_GROUP + 1, LINES_OF_A_GROUP), "\n")))
    parts = F.when((F.size(own) <= 1) & (F.size(lines) > 21), groups).otherwise(own)
    return docs.select(key, F.posexplode(F.filter(parts, lambda p: F.char_length(p) > least)).alias("chunk_index", "content"))


def exchanges(turns: DataFrame, least: int = LEAST_EXCHANGE, size: int = SIZE) -> DataFrame:
    """conv_id, turn, part, content from turns: a user's turn as a quote with the reply's first lines, cut at `size`."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("reply", F.lead("text").over(order)).where("role = 'user'")
    lines = F.filter(F.transform(F.split(F.col("reply"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    answer = F.when(F.col("next_role") == "assistant", F.array_join(F.slice(lines, 1, REPLY_LINES), " ")).otherwise("")
    whole = F.concat(F.lit("> "), F.coalesce("text", F.lit("")), F.when(answer != "", F.concat(F.lit("\n"), answer)).otherwise(""))
    parts = pairs.select("conv_id", "turn", whole.alias("whole")).select("conv_id", "turn", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.char_length("whole") - 1) / size).cast("int")), lambda i: F.substr("whole", i * size + 1, F.lit(size)))).alias("part", "content"))
    return parts.where(F.char_length(F.trim("content")) > least)


#: What opens a speaker's turn.
TURN = r"^(?:>\s|(?i:(?:Human|User|Q|Assistant|AI|A|Claude|ChatGPT)\s*:))"
TURNS_OF_A_TALK, GIANT = 3, 20


def segments(docs: DataFrame, key: str, text_col: str = "document") -> DataFrame:
    """key, segment, content to look for memories in: turns where three lines or more open one, else paragraphs.

    One paragraph of over 20 lines is cut into groups of 25 lines. Turns keep their lines as they are; paragraphs and
    groups are stripped, and empty ones left out. A null text has no segments.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(key, F.explode(F.array(lines)).alias("lines"))
    opens = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.trim(F.element_at("lines", i)).rlike(TURN))
    rows = rows.select(key, "lines", F.explode(F.array(opens)).alias("opens"))
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), "opens"))
    ends = F.concat(F.slice(starts, 2, F.size("lines")), F.array(F.size("lines") + 1))
    turns = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice("lines", a, b - a), "\n"))
    own = F.filter(F.transform(F.split(F.array_join("lines", "\n"), "\n\n"), _stripped), lambda p: p != "")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_OF_A_GROUP).cast("int")), lambda g: _stripped(F.array_join(F.slice("lines", g * LINES_OF_A_GROUP + 1, LINES_OF_A_GROUP), "\n")))
    plain = F.when((F.size(own) <= 1) & (F.size("lines") > GIANT), F.filter(groups, lambda p: p != "")).otherwise(own)
    return rows.select(key, F.posexplode(F.when(F.size("opens") >= TURNS_OF_A_TALK, turns).otherwise(plain)).alias("segment", "content"))


#: A session's time as its transcript shows it, and prompts that are commands.
SESSION_TIME = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
COMMANDS = r"^(?:\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"
MONTHS = "January February March April May June July August September October November December".split()


def session_heads(files: DataFrame, people: list[str], users: dict[str, str] | None = None, key: str = "file") -> DataFrame:
    """key, stamp, day, people, subject of files (key, lines: array<string>).

    The first time in 50 lines; known people named in 100 lines, or whose home folder is; the first prompt ('> ') of over
    five characters that is no command, as a file name of 60 characters at most, else 'session'.
    """
    lines = F.coalesce(F.col("lines"), F.array().cast("array<string>"))
    timed = F.try_element_at(F.filter(F.slice(lines, 1, 50), lambda x: x.rlike(SESSION_TIME)), F.lit(1))
    hour, month, day, year = (F.regexp_extract(timed, SESSION_TIME, i) for i in (1, 2, 3, 4))
    number = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("string"), 2, "0")
    iso = F.concat_ws("-", year, number, F.lpad(day, 2, "0"))
    head = F.array_join(F.slice(lines, 1, 100), "\n")
    named = [F.when(head.rlike(rf"(?i)\b{p}\b"), p) for p in people]
    user = F.regexp_extract(head, r"/Users/(\w+)/", 1)
    named += [F.when(user == u, p) for u, p in (users or {}).items()]
    found = F.sort_array(F.array_distinct(F.array_compact(F.array(*named)))) if named else F.array().cast("array<string>")
    prompts = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("> ")), lambda x: F.trim(F.substring(x, 3, 1 << 20))), lambda p: (F.char_length(p) > 5) & ~p.rlike(COMMANDS))
    subject = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.try_element_at(prompts, F.lit(1)), r"[^\w\s-]", "")), r"\s+", "-"), 1, 60)
    return files.select(key, F.when(timed.isNotNull(), F.concat(iso, F.lit("_"), F.regexp_replace(hour, "[: ]", ""))).alias("stamp"), F.when(timed.isNotNull(), iso).alias("day"), found.alias("people"), F.coalesce(subject, F.lit("session")).alias("subject"))


def is_exchange(text: Column) -> Column:
    """Three quoted lines or more."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith(">"))) >= 3


def sessions(lines: DataFrame, header: str, key: str = "file", least: int = 10) -> DataFrame:
    """key, session, first_line, n_lines of (key, n, line): a file of several sessions, split at lines that match `header`.

    A header with 'Ctrl+E' or 'previous messages' among the six lines from it on restores a session and begins none.
    """
    order = Window.partitionBy(key).orderBy("n")
    ahead = F.array_join(F.collect_list("line").over(order.rowsBetween(0, 5)), "\n")
    marked = lines.withColumn("begins", (F.col("line").rlike(header) & ~ahead.rlike("Ctrl\\+E|previous messages")).cast("int"))
    numbered = marked.withColumn("session", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.where("session > 0").groupBy(key, "session").agg(F.min("n").alias("first_line"), F.count("*").alias("n_lines"))
    several = F.count("*").over(Window.partitionBy(key))
    return found.withColumn("several", several).where((F.col("several") >= 2) & (F.col("n_lines") >= least)).drop("several")


def _often(words: Column, most: int = 5) -> Column:
    """The words that occur twice or more, the commonest first, of equal ones the one that stands first."""
    size = F.size(words)
    counts = F.transform(F.array_distinct(words), lambda w: F.struct((F.size(F.array_remove(words, w)) - size).alias("n"), F.array_position(words, w).alias("at"), w.alias("word")))
    return F.transform(F.slice(F.sort_array(F.filter(counts, lambda c: c["n"] <= -2)), 1, most), lambda c: c["word"])


def closet_lines(text: Column, drawer_ids: Column, fallback: Column) -> Column:
    """An array of lines topic|entities|->drawers: what was done, headers, quotes; one line of the fallback without any."""
    window = F.substring(F.coalesce(text, F.lit("")), 1, CLOSET_WINDOW)
    words = F.regexp_extract_all(window, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))
    often = F.element_at(F.transform(F.array(words), lambda found: _often(found)), 1)  # the words are found once, and bound to the function's argument
    tail = F.concat(F.lit("|"), F.array_join(often, ";"), F.lit("|→"), F.array_join(F.slice(drawer_ids, 1, 3), ","))
    done = F.regexp_extract_all(window, F.lit(r"(?i)(?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[\w\s]{3,40}"), F.lit(0))
    heads = F.regexp_extract_all(window, F.lit(r"(?m)^#{1,3}\s+(.{5,60})$"), F.lit(1))
    topics = F.slice(F.array_distinct(F.transform(F.concat(done, heads), lambda t: F.lower(F.trim(t)))), 1, 12)
    quotes = F.transform(F.slice(F.regexp_extract_all(window, F.lit('"([^"]{15,150})"'), F.lit(1)), 1, 3), lambda q: F.concat(F.lit('"'), q, F.lit('"')))
    lines = F.transform(F.concat(topics, quotes), lambda x: F.concat(x, tail))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.concat(fallback, tail)))


def pack(lines: Column, most: int = CLOSET_CHARS) -> Column:
    """Lines joined to closets of at most `most` characters each, in order, no line cut; a longer line stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("last"))

    def add(state: Column, line: Column) -> Column:
        fits = (state["last"] == "") | (F.char_length(state["last"]) + 1 + F.char_length(line) + 1 <= most)
        joined = F.when(state["last"] == "", line).otherwise(F.concat(state["last"], F.lit("\n"), line))
        return F.struct(F.when(fits, state["full"]).otherwise(F.array_append(state["full"], state["last"])).alias("full"), F.when(fits, joined).otherwise(line).alias("last"))

    return F.aggregate(lines, start, add, lambda s: F.when(s["last"] == "", s["full"]).otherwise(F.array_append(s["full"], s["last"])))


def closet_drawers(closet: Column) -> Column:
    """The drawer ids that a closet's lines point to, in order, each once."""
    refs = F.regexp_extract_all(closet, F.lit(r"→([\w,\-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(refs, lambda r: F.split(r, ","))), lambda x: x != ""))


def route(files: DataFrame, rooms: list[tuple[str, list[str]]]) -> DataFrame:
    """files (path, text) with room: by a folder of the path, else the file name, else most keywords in 2000 characters, else general."""
    parts = F.split(F.lower("path"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    low = F.lower(F.substring("text", 1, 2000))

    def like(part: Column, name: str) -> Column:
        return part.contains(name) | F.lit(name).contains(part)

    def times(word: str) -> Column:
        return (F.char_length(low) - F.char_length(F.replace(low, F.lit(word), F.lit("")))) / len(word)

    by_folder = F.array_compact(F.transform(folders, lambda p: F.coalesce(*[F.when(F.lit(False) if not (name or words) else _any([like(p, n.lower()) for n in (name, *words)]), name) for name, words in rooms])))
    by_name = F.coalesce(*[F.when(like(stem, name.lower()), name) for name, _ in rooms])
    counts = [F.struct(sum((times(w.lower()) for w in words), times(name.lower())).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rooms)]
    best = F.array_max(F.array(*counts))
    return files.withColumn("room", F.coalesce(F.try_element_at(by_folder, F.lit(1)), by_name, F.when(best["n"] > 0, best["name"]), F.lit("general")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
