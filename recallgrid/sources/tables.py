"""The engine's data model as views over Parquet tables: drawers, vectors, turns, triples, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Day number of 2024-01-01, from which the test drawers are filed.
FIRST_DAY = 19723


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawer_id(wing: Column, room: Column, key: Column) -> Column:
    """drawer_{wing}_{room}_ and 16 hex digits of the key's MD5: the same chunk gets the same id whenever it is filed."""
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.md5(key.cast("binary")), 1, 16))


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawer_id, wing, room, document, source_file, chunk_index, filed_day."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        drawer_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("drawer_id"),
        F.col("lang").alias("wing"),
        F.col("source").alias("room"),
        F.col("text").alias("document"),
        F.col("source").alias("source_file"),
        F.col("doc_id").alias("chunk_index"),
        (FIRST_DAY + F.col("doc_id") % 365).cast("int").alias("filed_day"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (the container), v as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, kind, ts, value, props of the events table."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value", "props")


def _triples(df: DataFrame, subject: Column, predicate: str, obj: Column, start: Column | None = None, end: Column | None = None, confidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), (none if start is None else start).alias("valid_from"), (none if end is None else end).alias("valid_to"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with validity (ISO text, null: open): who is where, what belongs where, who ordered what."""
    customer, nation, region, supplier, orders = (table(spark, sf_dir, n) for n in ("customer", "nation", "region", "supplier", "orders"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"))
    return (
        _triples(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "located_in", F.col("n_name"))
        .unionByName(_triples(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "part_of", F.col("r_name")))
        .unionByName(_triples(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_name"), "located_in", F.col("n_name")))
        .unionByName(_triples(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("c_name"), "ordered", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), day, end))
    )
