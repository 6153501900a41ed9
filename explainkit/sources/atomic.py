"""Typed tab-separated files of interactions, users and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inter_rows(df: DataFrame) -> DataFrame:
    """``(user_id, item_id, rating, tag)`` with statements joined by commas."""
    return df.select(F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("item_id"), F.col("rating").cast("double").alias("rating"), F.array_join("statement_ids", ",").alias("tag"))


def id_rows(df: DataFrame, key: str) -> DataFrame:
    """Ascending distinct ids."""
    return df.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key)


def write_atomic(splits: DataFrame, folder: str) -> None:
    """One folder for each of inter, train, eval, test, user and item, with typed headers."""
    typed = lambda df: df.toDF("user_id:token", "item_id:token", "rating:float", "tag:token_seq")
    save = lambda df, name: df.write.mode("overwrite").options(sep="\t", header="true").csv(f"{folder}/{name}")
    save(typed(inter_rows(splits)), "inter")
    for part in ("train", "eval", "test"):
        save(typed(inter_rows(splits.where(F.col("split") == part))), part)
    for key in ("user", "item"):
        save(id_rows(splits, f"{key}_id").toDF(f"{key}_id:token"), key)
