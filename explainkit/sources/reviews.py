"""Review files: schemas, guards and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explainkit.functions.json_text import parse_int_list

# The columns of raw review files and their names here.
RAW_REVIEW = "overall double, unixReviewTime long, reviewText string, reviewerName string, reviewerID string, asin string, summary string"
RENAMED = {"overall": "rating", "unixReviewTime": "timestamp", "reviewText": "review", "reviewerName": "user_name", "reviewerID": "user_id", "asin": "item_id", "summary": "review_title"}
REQUIRED = {
    "statements": ["statement", "sentiment"],
    "dataset": ["user_id", "item_id", "rating", "statement_ids"],
    "pairs": ["sentiment", "statement_1_index", "statement_2_index", "bi_encoder_sim", "cross_encoder_sim"],
    "clusters": ["sentiment", "representative_index", "cluster_size", "member_indices"],
}
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """``df`` itself; an error if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_vectors(df: DataFrame, column: str = "embedding") -> int:
    """The vectors' common length; an error if they differ or are missing."""
    row = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high"), F.count_if(F.col(column).isNull()).alias("none")).first()
    if row["low"] != row["high"] or row["none"]:
        raise ValueError("vectors must be there and of one length")
    return row["low"]


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMED)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines with an explicit schema, under our names."""
    return renamed(spark.read.schema(RAW_REVIEW).json(path))


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV of statements, dataset rows, pairs or clusters; list literals become arrays."""
    df = require_columns(spark.read.options(**CSV).option("inferSchema", "true").csv(path), REQUIRED[kind], kind)
    for name in ("statement_ids", "member_indices"):
        if name in df.columns:
            df = df.withColumn(name, parse_int_list(F.col(name).cast("string")))
    return df


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``(statement_id, cluster_id)`` of a JSON object file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("k", "cluster_id")).select(F.col("k").cast("bigint").alias("statement_id"), "cluster_id")


def union_shards(parts: list[DataFrame]) -> DataFrame:
    """All shards as one table; a shard's ``rank`` column goes."""
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    return out


def shard(df: DataFrame, row_id: str, world: int, rank: int) -> DataFrame:
    """The rows of one of ``world`` interleaved shards."""
    return df.where(F.pmod(F.col(row_id), F.lit(world)) == rank)


def shard_ranges(df: DataFrame, row_id: str, batch: int, world: int, total: int) -> DataFrame:
    """``df`` with ``shard``: contiguous ranges of whole batches."""
    batches = -(-total // batch)
    per = max(1, -(-batches // world)) * batch
    return df.withColumn("shard", F.floor(F.col(row_id) / per).cast("int"))


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return df.join(done.select(key), key, "left_anti")
