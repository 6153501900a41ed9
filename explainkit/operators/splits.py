"""Leave-last-two splits of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leave_last_two(df: DataFrame, user: str = "user_id", item: str = "item_id", time: str = "ts", row_id: str = "interaction_id", min_interactions: int = 3, warm_start: bool = True) -> DataFrame:
    """``df`` with a ``split`` of train, eval or test; users with too few rows go, and so do evaluation
    rows whose item never occurs in training. Rows without user, item or time go first."""
    rows = df.dropna(subset=[user, item, time])
    back = W.partitionBy(user).orderBy(F.col(time).desc(), F.col(row_id).desc())
    ranked = rows.withColumn("_back", F.row_number().over(back)).withColumn("_n", F.count("*").over(W.partitionBy(user)))
    split = F.when(F.col("_back") == 1, "test").when(F.col("_back") == 2, "eval").otherwise("train")
    cut = ranked.where(F.col("_n") >= min_interactions).withColumn("split", split).drop("_back", "_n")
    if not warm_start:
        return cut
    warm = cut.where("split = 'train'").select(F.col(item).alias("_warm")).distinct()
    later = cut.where("split <> 'train'").join(warm, F.col(item) == F.col("_warm"), "left_semi")
    return cut.where("split = 'train'").unionByName(later)


def sorted_positions(df: DataFrame, user: str = "user_id", time: str = "ts", row_id: str = "interaction_id") -> DataFrame:
    """``df`` with ``sorted_pos``, its place in the order (user, time, row)."""
    from explainkit.operators.dictionary import dense_ids

    return dense_ids(df, [user, time, row_id], "sorted_pos")


def split_meta(splits: DataFrame) -> DataFrame:
    """One row of counts."""
    part = lambda s: F.count_if(F.col("split") == s).alias(s)
    train = lambda c: F.countDistinct(F.when(F.col("split") == "train", F.col(c)))
    return splits.agg(part("train"), part("eval"), part("test"), train("user_id").alias("users"), train("item_id").alias("items"))
