"""Text as column expressions: tokens, shingles, sentences, estimates, previews, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that are no index tokens. A caller may pass others.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might must shall can "
    "this that these those it its they them their we our you your i my me he she his her who what when where why how which if then so not no yes ok okay just very really "
    "also already still even only here there now too up out about like use get got make made take put come go see know think true false none null new old all any some"
).split()

#: An index token begins with a letter and has two characters or more.
TOKEN = r"[A-Za-z][A-Za-z0-9_\-]+"

#: Markers by topic, in order of precedence.
HALLS = {
    "emotions": "scared afraid worried happy sad love hate feel cry tears".split(),
    "consciousness": "consciousness conscious aware real genuine soul exist alive".split(),
    "memory": "memory remember forget recall archive palace store".split(),
    "technical": "code python script bug error function api database server".split(),
    "identity": ["identity", "name", "who am i", "persona", "self"],
    "family": "family kids children daughter son parent mother father".split(),
    "creative": "game gameplay player app design art music story".split(),
}
TOPICS = {
    "technical": "code python function bug error api database server deploy git test debug refactor".split(),
    "architecture": "architecture design pattern structure schema interface module component service layer".split(),
    "planning": "plan roadmap milestone deadline priority sprint backlog scope requirement spec".split(),
    "decisions": "decided chose picked switched migrated replaced trade-off alternative option approach".split(),
    "problems": "problem issue broken failed crash stuck workaround fix solved resolved".split(),
}


def tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Lower-case index tokens in order, repeats kept; null gives none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, at least 1."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(13) / F.lit(10))).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: s != "")


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; a text of fewer words has its single words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    """One line, cut to n characters with its dots."""
    line = F.translate(F.trim(text), "\n", " ")
    return F.when(F.char_length(line) > n, F.concat(F.substring(line, 1, n - 3), F.lit("..."))).otherwise(line)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_name(text: Column) -> Column:
    """A path component: other than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def quoted(text: Column) -> Column:
    """Markdown quote lines."""
    return F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def hits(text: Column, words) -> Column:
    """How many of the words occur anywhere in the text (as substrings, on purpose)."""
    found = F.lit(0)
    for w in words:
        found = found + text.contains(w).cast("int")
    return found


def first_topic(text: Column, topics=HALLS, prefix: str = "hall_", default: str = "general") -> Column:
    """The first topic, in the order given, that has a word in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for topic, words in topics.items():
        met = hits(low, words) > 0
        out = F.when(met, prefix + topic) if out is None else out.when(met, prefix + topic)
    return out.otherwise(prefix + default)


def best_topic(text: Column, topics=TOPICS, window: int | None = 3000, default: str = "general") -> Column:
    """The topic with most of its words in the first `window` characters; ties go to the earlier topic."""
    low = F.lower(F.coalesce(F.substring(text, 1, window) if window else text, F.lit("")))
    scores = {t: hits(low, words) for t, words in topics.items()}
    best, out = F.greatest(*scores.values()), None
    for topic, score in scores.items():
        met = (score == best) & (best > 0)
        out = F.when(met, topic) if out is None else out.when(met, topic)
    return out.otherwise(default)


def valid_name(name: Column) -> Column:
    """128 characters at most, of letters, digits, blank, dot, dash, quote and underscore, not beginning or ending oddly, no path steps."""
    return (F.char_length(name) <= 128) & name.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9_ .'-]*[A-Za-z0-9])?$") & ~name.contains("..")


def valid_content(text: Column, most: int = 100_000) -> Column:
    return (F.trim(text) != "") & (F.char_length(text) <= most) & ~text.contains("\x00")
