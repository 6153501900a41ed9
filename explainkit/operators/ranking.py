"""Ranking metrics from the ranks of positives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def ideal_dcg(n: Column, k: int) -> Column:
    """Discounted gain of ``min(n, k)`` hits at the top, from a constant prefix-sum table."""
    import math

    sums = [0.0]
    for r in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(r + 1))
    return F.get(F.array(*map(F.lit, sums)), F.least(n, F.lit(k)).cast("int"))


def ranking_metrics(positives: DataFrame, key: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """``positives (key..., rank)`` to one row a sample: ``n_pos`` and hit, precision, recall and ndcg at each k.

    A sample is valid if it has a positive among its candidates; precision divides by k whatever the
    number of candidates.
    """
    sums = [F.count("*").alias("n_pos")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"_h{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_d{k}")]
    rows = positives.groupBy(*key).agg(*sums)
    out = [*map(F.col, key), F.col("n_pos")]
    for k in ks:
        hits = F.col(f"_h{k}")
        out += [F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit{k}"), (hits / F.lit(float(k))).alias(f"p{k}"), (hits / F.col("n_pos")).alias(f"r{k}"), (F.col(f"_d{k}") / ideal_dcg(F.col("n_pos"), k)).alias(f"ndcg{k}")]
    return rows.select(*out)


def macro_average(rows: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Means over the valid samples; zero if there are none."""
    return rows.agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), digits).alias(m) for m in names])


def offset_masks(rows: DataFrame, length: str = "k") -> DataFrame:
    """Class of each candidate place from the five clamped ends: pos, common, user, item, neg or none; and the axes."""
    ends = ["pos_end", "common_end", "user_end", "item_end", "all_end"]
    e = {c: F.greatest(F.lit(0), F.least(F.col(c), F.col(length))) for c in ends}
    placed = rows.where(F.col(length) > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col(length) - 1)))
    at, kind = F.col("pos"), F.lit("none")
    # later classes start where the earlier ends; an earlier class wins only inside its own range
    for name, low, high in reversed([("pos", F.lit(0), e["pos_end"]), ("common", e["pos_end"], e["common_end"]), ("user", e["common_end"], e["user_end"]), ("item", e["user_end"], e["item_end"]), ("neg", e["item_end"], e["all_end"])]):
        kind = F.when((at >= low) & (at < high), name).otherwise(kind)
    kept = placed.withColumn("kind", kind)
    return kept.withColumn("axis_user", F.col("kind").isin("pos", "common", "user")).withColumn("axis_item", F.col("kind").isin("pos", "common", "item"))


def metrics_by_axis(candidates: DataFrame, key: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """``candidates (key..., sid, score, is_pos, axis_user, axis_item)`` to metrics on the axes all, user and item."""
    from explainkit.operators.popularity import rank_within

    parts = []
    for axis, keep in (("all", F.lit(True)), ("user", F.col("axis_user")), ("item", F.col("axis_item"))):
        parts.append(candidates.where(keep).withColumn("axis", F.lit(axis)))
    ranked = rank_within(reduce(DataFrame.unionByName, parts), [*key, "axis"])
    return ranking_metrics(ranked.where("is_pos"), [*key, "axis"], ks)


def legacy_list_metrics(predicted: DataFrame, truth: DataFrame, key: str, value: str, top_k: int, digits: int = 6) -> DataFrame:
    """One row ``ndcg, precision, recall, f1``: gains over the full-depth discount sum, F1 averaged by sample.

    ``predicted (key, value, rank)``, ``truth (key, value)``; every key of ``truth`` is a sample.
    """
    import math

    total = sum(1 / math.log(i + 2) for i in range(top_k))
    truth = truth.select(key, value).distinct()
    hits = predicted.where(F.col("rank") <= top_k).join(truth, [key, value]).groupBy(key).agg(F.count("*").alias("h"), F.sum(1 / F.log(F.col("rank") + 1.0)).alias("g"))
    rows = truth.groupBy(key).agg(F.count("*").alias("n")).join(hits, key, "left")
    h = F.coalesce("h", F.lit(0))
    p, r = h / F.lit(float(top_k)), h / F.col("n")
    rows = rows.select((F.coalesce("g", F.lit(0.0)) / total).alias("ndcg"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
    return rows.agg(*[F.round(F.avg(c), digits).alias(c) for c in rows.columns])
