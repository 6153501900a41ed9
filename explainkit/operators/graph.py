"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.plans.storage import drop_path, persist_path


def symmetric_edges(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Each undirected edge in both directions, once; self loops go."""
    keys = group or []
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(*keys, "src", "dst").union(back).where("src <> dst").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")),
        ).first()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each node that has an edge: ``(node, component)``.

    Alternating large-star and small-star rounds: every round is two aggregations with map-side
    minima and two equi-joins, and the edge table only shrinks towards stars, so a component of any
    size is spread over all tasks. Each round is written to the shared folder, so lineage stays flat, and the
    round before it is dropped.
    Null ends and self loops are dropped; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    work, place = persist_path(
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct(),
        "edges",
    )
    seen = _signature(work)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = work.union(work.select("dst", "src")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every edge now points from the larger id to the smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = (
            pairs.select(F.explode(F.array(F.struct(F.col("v").alias("src"), F.col("m").alias("dst")), F.struct(F.col("u").alias("src"), F.col("m").alias("dst")))).alias("e"))
            .select("e.*")
            .where("src <> dst")
            .distinct()
        )
        before, (work, place) = place, persist_path(small, "edges")
        drop_path(spark, before)
        now = _signature(work)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = work.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return work.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
