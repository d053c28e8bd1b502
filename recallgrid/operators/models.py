"""Where models come in: facts from a model's answers, embeddings, and shorter texts. Models are call-backs; none is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a call, and the characters of a text that an extractor is shown.
BATCH, SHOWN = 64, 8000
LEAST_CONFIDENCE, MOST_CONFIDENCE, USUAL = 0.1, 0.9, 0.6
_FACT = "subject string, predicate string, object string, confidence string, valid_from string"


def parse_facts(answers: DataFrame, key: str, raw_col: str = "raw") -> DataFrame:
    """key, subject, predicate, object, confidence, valid_from of the facts that a model's answers hold as JSON.

    Code fences and prose around the first list go; one object alone is a list of one. Facts without a subject, a
    predicate or an object are left out, and so is an answer that is no JSON (or null). A confidence that is no number is
    .6, others lie between .1 and .9.
    """
    text = F.regexp_replace(F.trim(F.coalesce(F.col(raw_col), F.lit(""))), r"^```(?:json)?\s*|\s*```\s*$", "")
    block = F.coalesce(F.nullif(F.regexp_extract(text, r"\[[\s\S]*\]", 0), F.lit("")), text)
    listed = F.when(block.startswith("["), block).otherwise(F.concat(F.lit("["), block, F.lit("]")))
    rows = answers.select(key, F.explode(F.from_json(listed, f"array<struct<{_FACT.replace(' string', ':string')}>>")).alias("f")).select(key, "f.*")
    rows = rows.select(key, F.trim("subject").alias("subject"), F.replace(F.lower(F.trim("predicate")), F.lit(" "), F.lit("_")).alias("predicate"), F.trim("object").alias("object"), "confidence", "valid_from")
    number = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(USUAL))
    return rows.where("subject <> '' AND predicate <> '' AND object <> ''").withColumn("confidence", F.greatest(F.lit(LEAST_CONFIDENCE), F.least(F.lit(MOST_CONFIDENCE), number)))


def ask(texts: DataFrame, key: str, text_col: str, model: Callable[[list[str]], list[str]], shown: int = SHOWN) -> DataFrame:
    """key, raw, failed: the model's answers, BATCH texts a call; blank texts aren't asked about. A call that raises fails its texts only."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                part = whole.slice(start, BATCH)
                said = part.column(1).to_pylist()
                try:
                    raw, failed = [str(x) for x in model(said)], False
                    if len(raw) != len(said):
                        raise ValueError("a model gives one answer for each text")
                except Exception:  # whatever a model raises, the other texts go on
                    raw, failed = [None] * len(said), True
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.string()), pa.array([failed] * len(said))], [key, "raw", "failed"])

    shown_texts = texts.where(F.trim(text_col) != "").select(key, F.substring(text_col, 1, shown).alias("text"))
    return shown_texts.mapInArrow(run, f"{key} {kind}, raw string, failed boolean")


def extraction_stats(answers: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row: asked, failed, without_facts, facts."""
    each = answers.join(facts.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return each.agg(F.count("*").alias("asked"), F.count_if("failed").alias("failed"), F.count_if(~F.col("failed") & F.col("n").isNull()).alias("without_facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))


def embed(texts: DataFrame, key: str, text_col: str, model: Callable[[list[str]], Sequence[Sequence[float]]]) -> DataFrame:
    """key and v (array<double>), BATCH texts a call; a null text is embedded as an empty one. A model that raises ends the job."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                part = whole.slice(start, BATCH)
                found = [[float(x) for x in v] for v in model([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], [key, "v"])

    return texts.select(key, text_col).mapInArrow(run, f"{key} {kind}, v array<double>")
