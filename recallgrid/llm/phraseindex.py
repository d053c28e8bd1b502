"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings (row, token, position) of the training texts for the tokens that the test phrases
use, written to the shared folder, with a header (position -1) for each row. A search takes each window's rarest
term and the next rarest; the first list's positions, shifted by the terms' distance, are intersected with the
second's. What is left are diagonals (row, phrase, position of the phrase's first word). A diagonal is then met with
the lists of all the phrase's terms, and its runs of matching words are the exact matches. Joins are on a row and a
position, or on tokens against the test side, so no key gathers the rows of a frequent word or passage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import unused_name, write_shared

#: Letters, digits and whatever is not ASCII; lower-casing A-Z does not move a word's borders.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER = "\x00"

#: Rows up to which a table of the test side, or of row numbers, is broadcast; above, the join shuffles.
MOST_BROADCAST = 1_000_000


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """A text's words as they stand; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


@dataclass
class Phrases:
    """The test side: distinct word sequences, their terms, and the items that have them."""

    terms: DataFrame  # phrase, n, off, token
    vocabulary: DataFrame  # word, token
    items: DataFrame  # phrase, item

    @classmethod
    def of(cls, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Phrases:
        """Items without words have no phrase; items with equal words share one."""
        worded = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.transform(words_of(F.col(f"`{text_col}`")), lower_ascii).alias("words")).where(F.size("words") > 0)
        worded = write_shared(worded.withColumn("phrase", F.sha2(F.concat_ws(" ", "words"), 256)), "items")
        # The table of distinct words gets its numbers once, when it is written.
        words = worded.select(F.explode("words").alias("word")).distinct().withColumn("token", F.monotonically_increasing_id())
        vocabulary = write_shared(words, "vocabulary")
        sequences = worded.dropDuplicates(["phrase"]).select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "word"))
        terms = write_shared(sequences.join(vocabulary, "word").select("phrase", "n", "off", "token"), "terms")
        return cls(terms, vocabulary, worded.select("phrase", "item").distinct())


@dataclass
class PositionalIndex:
    """Postings of the training side for a vocabulary, and a header for each of its rows."""

    postings: DataFrame  # row, id, digest, n_words, pos, token

    @classmethod
    def build(cls, docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
        text = F.col(f"`{text_col}`")
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), words_of(text).alias("words"))
        each = rows.select("row", "id", "digest", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEADER)), "words")).alias("at", "raw"))
        header = docs.sparkSession.range(1).select(F.lit(HEADER).alias("word"), F.lit(-1).cast("long").alias("token"))
        known = _small(vocabulary.union(header))
        found = each.join(known, lower_ascii(F.col("raw")) == F.col("word"))
        return cls(write_shared(found.select("row", "id", "digest", "n_words", (F.col("at") - 1).alias("pos"), "token"), "postings"))

    def headers(self) -> DataFrame:
        return self.postings.where("token = -1").select("row", "id", "digest", "n_words")

    def lists(self) -> DataFrame:
        return self.postings.where("token >= 0").select("row", "pos", "token")

    def _rarity(self, terms: DataFrame) -> DataFrame:
        """The terms with df: how often the token stands in the training side."""
        counts = self.lists().groupBy("token").agg(F.count("*").alias("df"))
        return terms.join(counts, "token", "left").fillna(0, ["df"])

    def exact(self, phrases: Phrases, window: int = 13) -> DataFrame:
        """Rows (row, phrase, first, last, off): maximal runs of `window` consecutive phrase words or more.

        A phrase of fewer words is one window. first and last are positions in the row, off is the first word's in
        the phrase.
        """
        order = Window.partitionBy("phrase").orderBy("off")
        terms = self._rarity(phrases.terms).withColumn("ahead", F.sort_array(F.collect_list(F.struct("df", "off", "token")).over(order.rowsBetween(0, window - 1))))
        rare = terms.where((F.col("off") + F.least(F.lit(window), "n") <= F.col("n")) & (F.col("ahead")[0]["df"] > 0))
        # element 1 is absent where the phrase is one word: get() gives null there
        pick = [F.get("ahead", F.lit(i))[c].alias(f"{c}{i}") for i in (0, 1) for c in ("off", "token")]
        anchors = write_shared(rare.select("phrase", *pick).distinct(), "anchors")
        first = self.lists().join(_small(anchors), F.col("token") == F.col("token0")).select("row", "phrase", (F.col("pos") - F.col("off0")).alias("diagonal"), "off1", "token1")
        first = first.where("diagonal + coalesce(off1, 0) >= 0")
        second = self.lists().join(_small(anchors.select("token1").distinct()), F.col("token") == F.col("token1"), "left_semi").select(F.col("row").alias("r"), F.col("pos").alias("p"), F.col("token").alias("t"))
        met = first.where("token1 is not null").join(second, (F.col("row") == F.col("r")) & (F.col("diagonal") + F.col("off1") == F.col("p")) & (F.col("token1") == F.col("t")), "left_semi")
        seeds = write_shared(met.union(first.where("token1 is null")).select("row", "phrase", "diagonal").distinct(), "seeds")
        needed = seeds.join(_small(phrases.terms), "phrase").select("row", "phrase", "n", "diagonal", "off", (F.col("diagonal") + F.col("off")).alias("pos"), "token").where("pos >= 0")
        there = self.lists().join(_small(seeds.select("row").distinct()), "row", "left_semi")
        matched = needed.join(there, ["row", "pos", "token"])
        runs = matched.withColumn("run", F.col("off") - F.row_number().over(Window.partitionBy("row", "phrase", "diagonal").orderBy("off")))
        runs = runs.groupBy("row", "phrase", "diagonal", "run").agg(F.min("off").alias("off"), F.max("off").alias("to"), F.first("n").alias("n"))
        return runs.where(F.col("to") - F.col("off") + 1 >= F.least(F.lit(window), "n")).select("row", "phrase", (F.col("diagonal") + F.col("off")).alias("first"), (F.col("diagonal") + F.col("to")).alias("last"), "off")

    def proximity(self, phrases: Phrases, span: int) -> DataFrame:
        """Rows (row, phrase, pos): places of a phrase's rarest term where `span` consecutive words have all its terms.

        Order and repeats of the terms don't matter. Phrases of more than `span` distinct terms match nowhere.
        """
        distinct = self._rarity(phrases.terms).groupBy("phrase", "token").agg(F.first("df").alias("df"))
        distinct = distinct.withColumn("anchor", F.row_number().over(Window.partitionBy("phrase").orderBy("df", "token")) == 1)
        distinct = distinct.withColumn("n", F.count("*").over(Window.partitionBy("phrase"))).where(F.col("n") <= span)
        terms = write_shared(distinct, "near-terms")
        lists = self.lists().withColumn("part", F.floor(F.col("pos") / span))
        anchors = lists.join(_small(terms.where("anchor").select("phrase", "token", "n")), "token").select("row", "phrase", "n", "pos", F.explode(F.array(*[F.col("part") + i for i in (-1, 0, 1)])).alias("part"))
        wanted = anchors.join(_small(terms.select("phrase", "token")), "phrase")
        around = wanted.join(lists.withColumnRenamed("pos", "at"), ["row", "part", "token"]).where(F.abs(F.col("at") - F.col("pos")) < span)
        hits = around.groupBy("row", "phrase", "n", "pos").agg(F.collect_list(F.struct("at", "token")).alias("hits"))

        def holds(start: Column) -> Column:
            inside = F.filter("hits", lambda h: h["at"].between(start, start + span - 1))
            return F.size(F.array_distinct(F.transform(inside, lambda h: h["token"]))) == F.col("n")

        return hits.where(F.exists(F.sequence(F.col("pos") - span + 1, F.col("pos")), holds)).select("row", "phrase", "pos")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, one_in: int = 20) -> DataFrame:
    """For each row of docs: id_col, digest, n_words, n_hit, n_items, items (sorted ids) and contaminated.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. A word is hit
    if it lies in an occurrence of any `window` consecutive words of an item (of all its words, if it has fewer); a
    row is contaminated if at least one word in `one_in` is hit. Null texts have no words; such rows, and rows of an empty
    items table, have no hits. Items without an id count as hits but not as items. Repeated rows and ids give a row
    each; digest (the text's xxhash64) tells rows apart that share an id. Other columns aren't carried over.
    """
    phrases = Phrases.of(items, item_col, item_text)
    index = PositionalIndex.build(docs, phrases.vocabulary, id_col, text_col)
    runs = write_shared(index.exact(phrases, window), "runs")
    before = F.max("last").over(Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    covered = runs.select("row", "first", "last").distinct().withColumn("before", before)
    hit = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(F.col("before"), F.lit(-1)) + 1) + 1)).alias("n_hit"))
    named = runs.select("row", "phrase").distinct().join(phrases.items.where("item is not null"), "phrase").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = index.headers().join(hit, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "digest",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(f"`{id_col}`", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """docs without its contaminated rows (see contamination()), all columns kept; null ids are compared as values."""
    own, digest = unused_name(docs, "id"), unused_name(docs, "digest")
    bad = contamination(docs, items, id_col, text_col, **rules).where("contaminated").select(F.col(f"`{id_col}`").alias(own), F.col("digest").alias(digest)).distinct()
    bad = _small(write_shared(bad, "contaminated"))
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(digest)), "left_anti")
