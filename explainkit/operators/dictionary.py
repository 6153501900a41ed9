"""Dictionaries: ids by first appearance, statement encoding, cluster maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from explainkit.plans.storage import persist_table


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with ids 0, 1, 2, ... in a global order, without one task that sorts all.

    Rows are range-partitioned and numbered inside their partition; the partitions' offsets are a small
    table (a row a partition) that is joined back.
    """
    placed = persist_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order)
    numbered = placed.withColumn("_inside", F.row_number().over(inside)).join(before, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_before", "_inside")


def running_totals(df: DataFrame, order: list[str], **values: str) -> DataFrame:
    """``df`` with the totals of ``values`` (new name: column) over all rows up to and including each, in a global
    order, without one task that holds all: partitions are ranges, and their sums a small table (a row a partition).
    Rows equal in ``order`` are told apart by their place, so ``order`` should be unique."""
    placed = persist_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    upto = W.orderBy("_part")
    before = sums.select("_part", *[(F.sum(f"_{n}").over(upto) - F.col(f"_{n}")).alias(f"_{n}") for n in values])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    each = placed.withColumns({n: F.sum(c).over(inside) for n, c in values.items()}).join(before, "_part")
    return each.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_part", *[f"_{n}" for n in values])


def id_map_first_seen(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """``(key, idx)`` in the order in which keys first appear."""
    return dense_ids(df.groupBy(key).agg(F.min(row_id).alias("_first")), ["_first", key], "idx").select(key, "idx")


def dict_encode(df: DataFrame, row_id: str = "row_id", statements: str = "statements") -> tuple[DataFrame, DataFrame]:
    """Dictionary ``(statement_id, statement, sentiment, frequency)`` and rows ``(row_id, statement_ids)``.

    Ids follow first appearance; frequency counts every occurrence. Statements outside the three
    sentiments or without text are skipped; rows left without a statement have no list.
    """
    each = df.select(row_id, F.posexplode(statements).alias("pos", "s")).select(row_id, "pos", F.col("s.statement").alias("statement"), F.lower(F.trim("s.sentiment")).alias("sentiment"))
    each = each.where(F.col("sentiment").isin("positive", "neutral", "negative") & F.col("statement").isNotNull())
    first = each.groupBy("statement", "sentiment").agg(F.min(F.struct(row_id, "pos")).alias("_first"), F.count("*").alias("frequency"))
    flat = first.select("statement", "sentiment", "frequency", F.col(f"_first.{row_id}").alias("_row"), F.col("_first.pos").alias("_pos"))
    dictionary = persist_table(dense_ids(flat, ["_row", "_pos"], "statement_id").select("statement_id", "statement", "sentiment", "frequency"), "dictionary")
    ids = each.join(dictionary, ["statement", "sentiment"]).groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "statement_id"))).alias("l"))
    return dictionary, ids.select(row_id, F.transform("l", lambda x: x["statement_id"]).alias("statement_ids"))


def apply_cluster_map(df: DataFrame, mapping: DataFrame, row_id: str = "interaction_id", ids: str = "statement_ids") -> DataFrame:
    """``(row_id, cluster_ids)``: ids mapped and kept once, in first-seen order; unmapped ids are skipped, rows left empty go."""
    each = df.select(row_id, F.posexplode(ids).alias("pos", "statement_id")).join(mapping, "statement_id")
    first = each.groupBy(row_id, "cluster_id").agg(F.min("pos").alias("pos"))
    lists = first.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "cluster_id"))).alias("l"))
    return lists.select(row_id, F.transform("l", lambda x: x["cluster_id"]).alias("cluster_ids"))


def cluster_frequency(df: DataFrame, mapping: DataFrame, row_id: str = "interaction_id", ids: str = "statement_ids") -> DataFrame:
    """``(cluster_id, frequency)``: rows that use the cluster; unused clusters have zero."""
    used = df.select(row_id, F.explode(F.array_distinct(ids)).alias("statement_id")).join(mapping, "statement_id").select(row_id, "cluster_id").distinct()
    counts = used.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return mapping.select("cluster_id").distinct().join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("frequency"))
