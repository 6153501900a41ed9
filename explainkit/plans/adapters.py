"""Domain relations over the star-schema test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the statement universe.
STATEMENTS = 500
#: Groups of vectors.
GROUPS = 3


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def interactions(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """``(interaction_id, user_id, item_id, ts, rating, statement_ids)``: an order is a review of one item."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    item = "l_partkey" if sparse else "l_suppkey"
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    grouped = lines.groupBy("l_orderkey").agg(F.min(item).alias("item_id"), F.max("l_quantity").alias("rating"), F.array_sort(F.collect_list(entry)).alias("lines"))
    return orders.join(grouped, orders["o_orderkey"] == grouped["l_orderkey"]).select(
        F.col("o_orderkey").alias("interaction_id"),
        F.col("o_custkey").alias("user_id"),
        "item_id",
        F.col("o_orderdate").alias("ts"),
        "rating",
        F.transform("lines", lambda x: x["l_partkey"] % STATEMENTS).alias("statement_ids"),
    )


def interactions_sql(sparse: bool = False) -> str:
    item = "l_partkey" if sparse else "l_suppkey"
    return f"""interactions AS (SELECT o_orderkey AS interaction_id, o_custkey AS user_id, min({item}) AS item_id, o_orderdate AS ts,
        max(l_quantity) AS rating, list(l_partkey % {STATEMENTS} ORDER BY l_linenumber, l_partkey, l_suppkey) AS statement_ids
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""


SPLITS_SQL = """marked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, interaction_id DESC) AS back,
        count(*) OVER (PARTITION BY user_id) AS n FROM interactions),
    cut AS (SELECT interaction_id, user_id, item_id, ts, rating, statement_ids,
        CASE back WHEN 1 THEN 'test' WHEN 2 THEN 'eval' ELSE 'train' END AS split FROM marked WHERE n >= 3),
    splits AS (SELECT * FROM cut WHERE split = 'train' OR item_id IN (SELECT item_id FROM cut WHERE split = 'train'))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, grp, label, embedding)``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % GROUPS).alias("grp"), "label", "embedding")


VECTORS_SQL = f"vectors AS (SELECT vec_id AS id, label % {GROUPS} AS grp, label, embedding::DOUBLE[] AS v FROM embeddings)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, review, sentiment)`` of the documents."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("review"))
    labels = read(spark, sf_dir, "labels")
    mood = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return docs.join(labels, docs["row_id"] == labels["doc_id"], "left").select("row_id", "review", mood.alias("sentiment"))


REVIEWS_SQL = """reviews AS (SELECT d.doc_id AS row_id, text AS review,
        CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
