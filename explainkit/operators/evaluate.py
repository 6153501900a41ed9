"""Evaluation of rankers over candidate paradigms, as one lazy plan.

Only the ranks of positives are needed. Where a ranking doesn't depend on the whole sample it is made
once for each owner and shared: by a pool's owner where scores depend on nothing else, by closed form
where the pool is every statement. Where user and item both matter a sample meets its pool as an array; only
rankers other than the count rankers lay out all candidates a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.operators.popularity import CountRanker, Ranker, popularity_counts, random_ranks, rank_within, statement_sets, universe_ranks, valid_ids
from explainkit.operators.ranking import macro_average, ranking_metrics


def positives(test: DataFrame, size: int) -> DataFrame:
    """``(interaction_id, user_id, item_id, sid)``."""
    return test.select("interaction_id", "user_id", "item_id", F.explode(valid_ids(F.col("statement_ids"), size)).alias("sid"))


def pool(df: DataFrame, owner: str, size: int) -> DataFrame:
    """``(owner, sid)``: statements that an owner has in any split."""
    return df.select(owner, F.explode(valid_ids(F.col("statement_ids"), size)).alias("sid")).distinct()


def positive_ranks(ranker: Ranker, paradigm: str, splits: DataFrame, every: DataFrame, statements: DataFrame, size: int) -> DataFrame:
    """Ranks of the test positives among the paradigm's candidates: ``all``, ``user`` or ``item``."""
    wanted = positives(splits.where("split = 'test'"), size)
    if paradigm == "all":
        if isinstance(ranker, CountRanker):
            return universe_ranks(wanted, ranker.counts, ranker.owner, statements)
        return wanted.join(random_ranks(statements, ranker.seed), "sid")
    if paradigm not in {"user", "item"}:
        raise ValueError(f"unknown paradigm {paradigm}")
    owner = f"{paradigm}_id"
    candidates = pool(every, owner, size)
    if ranker.owner in (None, owner):
        ranked = rank_within(ranker.score(candidates), [owner]).select(owner, "sid", "rank")
        return wanted.join(ranked, [owner, "sid"])
    if isinstance(ranker, CountRanker):
        return sample_ranks(splits.where("split = 'test'"), ranker.counts, ranker.owner, every, owner, size)
    samples = wanted.select("user_id", "item_id").distinct()
    laid = ranker.score(samples.join(candidates, owner))
    return wanted.join(rank_within(laid, ["user_id", "item_id"]).select("user_id", "item_id", "sid", "rank"), ["user_id", "item_id", "sid"])


def sample_ranks(test: DataFrame, counts: DataFrame, scorer: str, every: DataFrame, owner: str, size: int) -> DataFrame:
    """Ranks of the positives of ``test`` among ``owner``'s pool, scored by ``scorer``'s ``counts``.

    No candidates are laid out: a row is a sample with its scorer's counted statements in order, and meets its owner's
    pool as one array. A counted statement stands where the counted ones of the pool put it; an uncounted one behind all
    of them, at its place by id in the pool less the counted before it.
    """
    listed = counts.where("cnt > 0").groupBy(scorer).agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "sid"))).alias("l"))
    samples = test.select("interaction_id", "user_id", "item_id", valid_ids(F.col("statement_ids"), size).alias("_asked"))
    samples = samples.join(listed.select(scorer, F.col("l.sid").alias("_counted")), scorer, "left")
    none = F.expr("array()").cast(samples.schema["_counted"].dataType)
    joined = samples.join(statement_sets(every, owner, size).withColumnRenamed("sids", "_pool"), owner)
    rows = joined.select("interaction_id", "user_id", "item_id", "_asked", "_pool", F.array_intersect(F.coalesce("_counted", none), "_pool").alias("_counted"))
    counted, pool_ = F.col("_counted"), F.col("_pool")

    def rank(sid):
        uncounted = F.size(counted) + F.array_position(pool_, sid) - F.size(F.filter(counted, lambda x: x < sid))
        return F.when(F.array_contains(counted, sid), F.array_position(counted, sid)).otherwise(uncounted)

    asked = F.filter("_asked", lambda s: F.array_contains(pool_, s))
    ranked = F.transform(asked, lambda s: F.struct(s.alias("sid"), rank(s).cast("int").alias("rank")))
    return rows.select("interaction_id", "user_id", "item_id", F.explode(ranked).alias("_r")).select("user_id", "item_id", "_r.sid", "interaction_id", "_r.rank")


def evaluate(ranker: Ranker, paradigm: str, splits: DataFrame, every: DataFrame, statements: DataFrame, size: int, k: int = 10) -> DataFrame:
    """One row: valid samples and macro averages at ``k``."""
    rows = ranking_metrics(positive_ranks(ranker, paradigm, splits, every, statements, size), ["interaction_id"], (k,))
    return macro_average(rows, [f"hit{k}", f"p{k}", f"r{k}", f"ndcg{k}"])


def ranker_named(name: str, splits: DataFrame, size: int) -> Ranker:
    """``random``, ``globalpop``, ``userpop`` or ``itempop``, fitted on the training split."""
    from explainkit.operators.popularity import RandomRanker

    train = splits.where("split = 'train'")
    if name == "random":
        return RandomRanker()
    owner = {"globalpop": None, "userpop": "user_id", "itempop": "item_id"}[name]
    return CountRanker(popularity_counts(train, size, owner), owner)
