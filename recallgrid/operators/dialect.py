"""A lossy one-line summary of a text: entities, topics, a key sentence, emotions, flags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word that occurs, and the code it stands for, in order.
EMOTIONS = {
    "decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage", "hope": "hope", "fear": "fear", "trust": "trust", "happy": "joy", "sad": "grief",
    "surprised": "surprise", "grateful": "grat", "curious": "curious", "wonder": "wonder", "anxious": "anx", "relieved": "relief", "satisf": "satis", "disappoint": "grief", "concern": "anx",
}
FLAGS = {
    "DECISION": ("decided", "chose", "switched", "migrated", "replaced", "instead of", "because"),
    "ORIGIN": ("founded", "created", "started", "born", "launched", "first time"),
    "CORE": ("core", "fundamental", "essential", "principle", "belief", "always", "never forget"),
    "PIVOT": ("turning point", "changed everything", "realized", "breakthrough", "epiphany"),
    "TECHNICAL": ("api", "database", "architecture", "deploy", "infrastructure", "algorithm", "framework", "server", "config"),
}
DECISIVE = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()
SKIP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about between through during before after above below up down out off over under again "
    "further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just don now and but or if while that this these those it its i we you he she they me him her us "
    "them my your his our their what which who whom also much many like because since get got use used using make made thing things way well really want need"
).split()

_SKIP = frozenset(SKIP)
_WORD = re.compile(r"[a-zA-Z][a-zA-Z_-]{2,}")


def _first(text: Column, codes: dict[str, tuple[str, ...] | str], n: int = 3) -> Column:
    low = F.lower(text)
    found = [F.when(low.rlike("|".join(words) if not isinstance(words, str) else words), code) for code, words in codes.items()]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, n)


def emotions(text: Column) -> Column:
    low = F.lower(text)
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(w), code) for w, code in EMOTIONS.items()]))), 1, 3)


def flags(text: Column) -> Column:
    return _first(text, FLAGS)


def topics(text: Column, n: int = 3) -> Column:
    """The words that count most: each occurrence 1, a capital first letter 2 more, an inner capital, dash or underscore 2 more.

    A count by word within a row would be quadratic in array functions, so batches of texts go through Python.
    """

    @F.pandas_udf("array<string>")
    def best(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str]:
            worth: dict[str, int] = {}
            for w in _WORD.findall(text or ""):
                low = w.lower()
                if low not in _SKIP:
                    worth[low] = worth.get(low, 0) + 1 + 2 * w[0].isupper() + 2 * ("_" in w or "-" in w or w[1:] != w[1:].lower())
            return sorted(worth, key=worth.get, reverse=True)[:n]

        return texts.map(of)

    return best(text)


def key_sentence(text: Column, most: int = 55) -> Column:
    """The first best sentence of over 10 characters: 2 for each decisive word, 1 below 80 and 1 below 40 characters, 2 less above 150."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: F.char_length(s) > 10)

    def worth(s: Column) -> Column:
        low, n = F.lower(s), F.char_length(s)
        words = sum((low.contains(w).cast("int") for w in DECISIVE[1:]), low.contains(DECISIVE[0]).cast("int"))
        return 2 * words + (n < 80).cast("int") + (n < 40).cast("int") - 2 * (n > 150).cast("int")

    best = F.array_max(F.transform(parts, lambda s, i: F.struct(worth(s).alias("n"), (-i).alias("at"), s.alias("s"))))["s"]
    return F.coalesce(F.when(F.char_length(best) > most, F.concat(F.substring(best, 1, most - 3), F.lit("..."))).otherwise(best), F.lit(""))


def entities(text: Column, n: int = 3) -> Column:
    """Codes of three letters of capitalised words that don't begin the text."""
    words = F.split(F.trim(text), r"\s+")
    clean = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    names = F.filter(clean, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(*SKIP))
    return F.slice(F.array_distinct(F.transform(names, lambda w: F.upper(F.substring(w, 1, 3)))), 1, n)


def summary(text: Column) -> Column:
    """0:entities|topics|"key sentence"|emotions|flags, parts that are empty left out."""

    def joined(values: Column, by: str, empty: str | None) -> Column:
        return F.when(F.size(values) > 0, F.array_join(values, by)).otherwise(F.lit(empty))

    key = key_sentence(text)
    quote = F.when(key != "", F.concat(F.lit('"'), key, F.lit('"')))
    return F.concat_ws("|", F.concat(F.lit("0:"), joined(entities(text), "+", "???")), joined(topics(text), "_", "misc"), quote, joined(emotions(text), "+", None), joined(flags(text), "+", None))


def header(wing: Column, room: Column, date: Column, source_file: Column) -> Column:
    """wing|room|date|file, a question mark for what is unknown."""
    stem = F.regexp_replace(F.element_at(F.split(source_file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("|", *[F.coalesce(F.nullif(c, F.lit("")), F.lit("?")) for c in (wing, room, date, stem)])


def decode(line: Column) -> Column:
    """struct(entities, topics, quote) of a summary."""
    parts = F.split(line, r"\|")
    return F.struct(
        F.split(F.regexp_replace(parts[0], "^0:", ""), r"\+").alias("entities"),
        F.split(F.try_element_at(parts, F.lit(2)), "_").alias("topics"),
        F.regexp_extract(line, '"([^"]*)"', 1).alias("quote"),
    )
