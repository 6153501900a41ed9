"""Popularity statistics, scorers and rankers over statements.

Rankings are sparse: a ranker's score table holds only statements with a count, every other statement
scores zero, and ties go to the smaller id. A statement's rank in the whole universe then has a closed
form, so no ranking of all statements is ever laid out for each user.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from explainkit.functions.hashing import stable_hash64, unsigned_order


def valid_ids(ids: Column, size: int) -> Column:
    """Distinct ids inside the universe."""
    return F.array_distinct(F.filter(ids, lambda x: x.between(0, size - 1)))


def popularity_counts(train: DataFrame, size: int, owner: str | None = None, ids: str = "statement_ids") -> DataFrame:
    """``([owner,] sid, cnt)``: interactions that mention a statement, each counted once."""
    keys = [owner] if owner else []
    return train.select(*keys, F.explode(valid_ids(F.col(ids), size)).alias("sid")).groupBy(*keys, "sid").agg(F.count("*").alias("cnt"))


def statement_sets(df: DataFrame, owner: str, size: int, ids: str = "statement_ids") -> DataFrame:
    """``(owner, sids)``: ascending distinct statements of each owner."""
    each = df.select(owner, F.explode(valid_ids(F.col(ids), size)).alias("sid"))
    return each.groupBy(owner).agg(F.array_sort(F.collect_set("sid")).alias("sids"))


class Ranker(Protocol):
    """Gives candidate rows ``(..., sid)`` a ``score``; ``owner`` is the column that a score depends on."""

    owner: str | None

    def score(self, candidates: DataFrame) -> DataFrame: ...


class RandomRanker:
    """One fixed permutation of the statements, by hash."""

    owner = None

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def score(self, candidates: DataFrame) -> DataFrame:
        """Smaller hashes first: the score is the negated order key, so that it descends. A statement is hashed
        once, however many candidate rows it has."""
        hashed = candidates.select(F.col("sid").alias("_sid")).distinct()
        hashed = hashed.withColumn("score", -unsigned_order(stable_hash64(F.col("_sid"), self.seed)).cast("decimal(20,0)"))
        return candidates.join(hashed, F.col("sid") == F.col("_sid")).drop("_sid")


class CountRanker:
    """Scores by counts: global, of the user or of the item."""

    def __init__(self, counts: DataFrame, owner: str | None = None) -> None:
        self.counts, self.owner = counts, owner

    def score(self, candidates: DataFrame) -> DataFrame:
        keys = [self.owner, "sid"] if self.owner else ["sid"]
        return candidates.join(self.counts, keys, "left").withColumn("score", F.coalesce("cnt", F.lit(0))).drop("cnt")


def rank_within(scored: DataFrame, group: list[str]) -> DataFrame:
    """``rank`` from 1 by score descending, then id."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.col("score").desc(), F.col("sid"))))


def top_k(scored: DataFrame, group: list[str], k: int) -> DataFrame:
    """The best ``k`` of each group; Spark limits each partition before the shuffle."""
    return rank_within(scored, group).where(F.col("rank") <= k)


def random_ranks(statements: DataFrame, seed: int = 0) -> DataFrame:
    """``(sid, rank)`` of the hash permutation."""
    key = unsigned_order(stable_hash64(F.col("sid"), seed))
    from explainkit.operators.dictionary import dense_ids

    return dense_ids(statements.select("sid", key.alias("_key")), ["_key", "sid"], "_at").select("sid", (F.col("_at") + 1).alias("rank"))


def universe_ranks(wanted: DataFrame, counts: DataFrame, owner: str | None, statements: DataFrame) -> DataFrame:
    """``wanted (..., [owner,] sid)`` with ``rank`` among all statements.

    A counted statement stands where its owner's counted list puts it; an uncounted one stands behind all
    counted ones, at its place among the uncounted: its place by id less the counted ids before it. Those are
    running counts over the owner's counted and wanted ids together; without an owner, over ranges of ids.
    """
    from explainkit.operators.dictionary import dense_ids, running_totals

    if owner is None:
        known = dense_ids(counts.select("sid", (-F.col("cnt")).alias("_neg")), ["_neg", "sid"], "_rank").select(F.col("sid").alias("_known"), (F.col("_rank") + 1).alias("_rank"))
        every = statements.select("sid").join(known, F.col("sid") == F.col("_known"), "left").select("sid", "_rank", F.lit(1).alias("_one"), F.col("_rank").isNotNull().cast("int").alias("_counted"))
        placed = running_totals(every, ["sid"], _place="_one", _before="_counted")
        n = counts.count()
        ranks = placed.select(F.col("sid").alias("_sid"), F.coalesce("_rank", F.col("_place") - F.col("_before") + F.lit(n)).alias("rank"))
        return wanted.join(ranks, F.col("sid") == F.col("_sid")).drop("_sid")
    places = dense_ids(statements.select("sid"), ["sid"], "_place").select(F.col("sid").alias("_sid"), "_place")
    listed = counts.select(owner, "sid", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("cnt"), "sid")).alias("_rank"))
    asked = wanted.select(owner, "sid").distinct()
    # a wanted id that is counted too is one row
    both = listed.unionByName(asked.withColumn("_rank", F.lit(None).cast("int"))).groupBy(owner, "sid").agg(F.max("_rank").alias("_rank"))
    mine = W.partitionBy(owner)
    counted = F.count("_rank").over(mine.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    ranked = both.withColumn("_before", counted).withColumn("_n", F.count("_rank").over(mine)).join(asked, [owner, "sid"], "left_semi")
    ranked = ranked.join(places, F.col("sid") == F.col("_sid")).select(owner, "sid", F.coalesce("_rank", 1 + F.col("_n") + F.col("_place") - F.col("_before")).alias("rank"))
    return wanted.join(ranked, [owner, "sid"])
