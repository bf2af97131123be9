"""The driver tables, and how they stand in for notes, questions, sessions, bullets and facts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table. `spread` redistributes a small input that has fewer splits than there are
    cores; a large input has more splits and is left where it is."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def doc_date() -> Column:
    """A day in January 2024 for each document (the tables carry no note dates)."""
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes(rel, text, in_vault, mtime, doc_id, source, lang, date)."""
    d = table(spark, sf_dir, "documents", True)
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), "text",
                    F.lit(True).alias("in_vault"), F.lit(None).cast("timestamp").alias("mtime"), "doc_id", "source", "lang",
                    doc_date().alias("date"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
