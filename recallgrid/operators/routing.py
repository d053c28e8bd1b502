"""Two-stage retrieval by summaries and rooms, preference phrases, promoted picks, and spelling with guards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text as T, vectors as V
from recallgrid.operators import fusion, metrics, vector

#: What introduces a preference, on lower-case text, and the phrase behind it up to a stop.
PREFERENCES = (
    r"i(?:'ve been| have been) having (?:trouble|issues?|problems?) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) feeling ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:struggling|dealing) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i(?:'m| am) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i prefer ([^,\.!?]{5,60})",
    r"i usually ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:trying|attempting) to ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:considering|thinking about) ([^,\.!?]{5,80})",
    r"lately[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"recently[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:working on|focused on|interested in) ([^,\.!?]{5,80})",
    r"i want to ([^,\.!?]{5,60})",
    r"i(?:'m| am) looking (?:to|for) ([^,\.!?]{5,60})",
    r"i(?:'m| am) thinking (?:about|of) ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:noticing|experiencing) ([^,\.!?]{5,80})",
)


def preference_phrases(text: Column, patterns: Sequence[str] = PREFERENCES, most: int = 10) -> Column:
    """Phrases of 5 to 80 characters behind what introduces a preference, each once, in the patterns' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns]))
    clean = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"[.,;!? ]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.char_length(x).between(5, 80))), 1, most)


def preference_documents(turns: DataFrame, **options) -> DataFrame:
    """conv_id and a made-up document that states a conversation's preferences, to be searched beside it under the same id.

    Turns are read in their order, so that which phrases come first doesn't depend on the shuffle.
    """
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    phrases = preference_phrases(F.array_join(said, "\n"), **options)
    found = turns.where("role = 'user'").groupBy("conv_id").agg(phrases.alias("p"))
    return found.where(F.size("p") > 0).select("conv_id", F.concat(F.lit("User has mentioned: "), F.array_join("p", "; ")).alias("document"))


def nearest_by_session(hits: DataFrame, by: str = "conv_id", distance: str = "distance") -> DataFrame:
    """Of several documents under one id the nearest stands for it."""
    return hits.groupBy(by).agg(F.min(distance).alias(distance))


def best_rooms(summaries: DataFrame, terms: Sequence[str], n: int, room: str = "room", text: str = "summary") -> DataFrame:
    """The n rooms whose summaries, taken together, share most of the terms; all rooms if none shares any.

    A room gathers one flag for each term, whatever the number of its summaries.
    """
    own = summaries.select(room, F.explode(F.array(T.tokens(F.col(text)))).alias("own"))  # explode keeps the tokens from being made for each term
    shared = sum((F.max(F.array_contains("own", t).cast("int")) for t in terms), F.lit(0))
    scored = own.groupBy(room).agg((F.coalesce(shared, F.lit(0)) / F.lit(float(len(terms) or 1))).alias("share"))
    top = scored.orderBy(F.desc("share"), room).limit(n)
    some = top.agg((F.max("share") > 0).alias("some"))
    kept = top.withColumn("kept", F.lit(True))
    return scored.join(kept.select(room, "kept"), room, "left").join(F.broadcast(some)).where("kept or not some").select(room)


def two_stage(vectors: DataFrame, documents: DataFrame, summaries: DataFrame, query: Sequence[float], terms: Sequence[str], k: int, id_col: str = "vec_id", weight: float = 0.5) -> DataFrame:
    """Sessions whose summaries share most terms (k of them, or a third if that is more), their 2k nearest, rescored by terms."""
    n = max(k, summaries.select(id_col).distinct().count() // 3)
    inside = best_rooms(summaries, terms, n, id_col)
    near = vector.knn(vectors, query, 2 * k, inside, id_col)
    fused = fusion.overlap_fused(1 - F.col("similarity"), fusion.overlap(F.col("document"), terms), weight)
    return near.join(documents, id_col).withColumn("distance", fused).orderBy("distance", id_col).limit(k)


#: What a question says that refers back to an answer.
ANSWER_CUES = (
    "you suggested", "you told me", "you mentioned", "you said", "you recommended", "remind me what you", "you provided", "you listed", "you gave me", "you described", "what did you",
)
#: Hall navigation: the factors of a distance in the first hall, in another that is asked for, and among the first hall's nearest.
FIRST_HALL, OTHER_HALL, FOUND_IN_HALL, HALL_POOL = 0.75, 0.9, 0.85, 10


def about_answers(question: str, cues: Sequence[str] = ANSWER_CUES) -> bool:
    """Whether a question asks about what the assistant said before."""
    low = question.lower()
    return any(c in low for c in cues)


def two_pass(asked: DataFrame, whole: DataFrame, query: Sequence[float], corpus: DataFrame, pool: int = 5, id_col: str = "vec_id", whole_query: Sequence[float] | None = None) -> DataFrame:
    """corpus (id_col, position) with rank, for a question about answers (whole_query: its vector for whole texts, if that is another one).

    The `pool` sessions whose user turns (asked: id_col, v) are nearest come first, in the order of their whole texts (whole: id_col, v);
    the others follow in corpus order.
    """
    first = vector.knn(asked, query, pool, id_col=id_col)
    again = vector.knn(whole, query if whole_query is None else whole_query, pool, first, id_col)
    order = Window.orderBy(F.desc("similarity"), id_col)  # `pool` rows at most
    return metrics.complete(again.select(id_col, F.row_number().over(order).alias("rank")), corpus, id_col)


def hall_navigation(vectors: DataFrame, query: Sequence[float], halls: Sequence[str], general: str = "hall_general", pool: int = HALL_POOL, id_col: str = "vec_id") -> DataFrame:
    """id_col, distance of vectors (id_col, hall, v), smaller in the halls that a question asks for (the likeliest first).

    The first hall's nearest `pool` are smaller still. Halls only move hits, none is hidden; `general` as the first hall asks for nothing.
    """
    first = halls[0] if halls and halls[0] != general else None
    distance = 1 - V.cosine(F.col("v"), V.literal(query))
    inside = F.col("hall") == first if first else F.lit(False)
    factor = F.when(inside, FIRST_HALL).when(F.col("hall").isin(*halls), OTHER_HALL).otherwise(1.0)
    scored = vectors.select(id_col, (distance * factor).alias("distance"))
    if first is None:
        return scored
    found = vector.knn(vectors.where(inside), query, pool, id_col=id_col).select(id_col, F.lit(True).alias("found"))
    joined = scored.join(F.broadcast(found), id_col, "left")  # `pool` rows at most
    return joined.select(id_col, F.when(F.col("found"), F.col("distance") * FOUND_IN_HALL).otherwise(F.col("distance")).alias("distance"))


def with_layer(hits: DataFrame, layer: DataFrame, by: str, factor: float = 0.8) -> DataFrame:
    """by, distance: sessions by the nearest of their own documents and of a layer's (a diary, say), which count as nearer by `factor`."""
    both = hits.select(by, "distance").union(layer.select(by, (F.col("distance") * factor).alias("distance")))
    return nearest_by_session(both, by)


def promote(ranking: DataFrame, pick, id_col: str, pool: int = 10) -> DataFrame:
    """ranking (id, rank from 1) with one pick of the first `pool` moved to the front; another pick changes nothing."""
    chosen = (F.col(id_col) == pick) & (F.col("rank") <= pool)
    place = ranking.where(chosen).agg(F.min("rank").alias("at"))
    joined = ranking.join(F.broadcast(place))
    return joined.withColumn("rank", F.when(chosen, 1).when(F.col("rank") < F.col("at"), F.col("rank") + 1).otherwise(F.col("rank"))).drop("at")


def entity_metadata(text: Column, most: int = 25) -> Column:
    """Capitalised words that stand in the text twice or more, by name, the first `most` of them joined by ';'."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))
    # In sorted words a word that stands there twice is its own successor.
    pairs = F.element_at(F.transform(F.array(F.sort_array(words)), lambda w: F.zip_with(w, F.slice(w, 2, F.size(w) + 1), lambda a, b: F.when(a == b, a))), 1)
    return F.array_join(F.slice(F.array_distinct(F.array_compact(pairs)), 1, most), ";")


_NO_SPELLING = r"\d|[A-Z]|[-_@#]|https?:|www\.|[^\x00-\x7F]|[`*<>{}|/\\]"


def corrected(text: Column, speller: Callable[[str], str], known: Sequence[str] = ()) -> Column:
    """A text with the speller's word for each plain lower-case word of four letters or more, where it is near enough.

    Names in `known`, words with digits, capitals or technical characters stay; a correction may change two letters,
    three in words of more than seven. The speller is a call-back: none is bundled.
    """
    import re

    names = {k.lower() for k in known}
    skip = re.compile(_NO_SPELLING)

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def word(m: re.Match) -> str:
        bare = m[0].rstrip(".,!?;:'\")")
        if len(bare) < 4 or skip.search(bare) or bare in names:
            return m[0]
        better = speller(bare)
        return better + m[0][len(bare) :] if distance(bare, better) <= (2 if len(bare) <= 7 else 3) else m[0]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else re.sub(r"\S+", word, t))

    return run(text)


def corrected_transcript(text: Column, speller: Callable[[str], str], known: Sequence[str] = ()) -> Column:
    """Only the lines that a user said (those that begin with >) are corrected."""
    lines = F.split(text, "\n")
    better = F.split(corrected(text, speller, known), "\n")
    return F.array_join(F.zip_with(lines, better, lambda a, b: F.when(F.trim(a).startswith(">"), b).otherwise(a)), "\n")
