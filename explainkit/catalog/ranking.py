"""Popularity, rankers, metrics and paired statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.catalog.scans import split_table
from explainkit.operators import evaluate, paired_stats, popularity, ranking
from explainkit.operators.splits import leave_last_two
from explainkit.plans.adapters import SPLITS_SQL, STATEMENTS, interactions, interactions_sql
from explainkit.plans.storage import persist_table

QUERIES: dict = {}
DENSE = f"WITH {interactions_sql()}, {SPLITS_SQL}, train AS (SELECT * FROM splits WHERE split = 'train'), test AS (SELECT * FROM splits WHERE split = 'test')"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits, all interactions and the statement universe."""
    return split_table(spark, d, False), interactions(spark, d), spark.range(STATEMENTS).select(F.col("id").alias("sid"))


def counts_sql(owner: str | None) -> str:
    key = f"{owner}, " if owner else ""
    return f"SELECT {key}sid, count(*) AS cnt FROM (SELECT {key}unnest(list_distinct(statement_ids)) AS sid FROM train) GROUP BY {key}sid"


def _counts(name: str, owner: str | None) -> None:
    @query(name, f"{DENSE} {counts_sql(owner)}")
    def _(spark, d):
        return popularity.popularity_counts(split_table(spark, d, False).where("split = 'train'"), STATEMENTS, owner)


_counts("global_pop", None)
_counts("user_pop", "user_id")
_counts("item_pop", "item_id")


# --- evaluation of four rankers over three candidate pools

POSITIVES = "pos AS (SELECT interaction_id, user_id, item_id, unnest(list_distinct(statement_ids)) AS sid FROM test)"


def candidates_sql(paradigm: str) -> str:
    if paradigm == "all":
        return f"cand AS (SELECT t.interaction_id, t.user_id, t.item_id, r.range AS sid FROM test t, range({STATEMENTS}) r)"
    key = f"{paradigm}_id"
    return f"""pool AS (SELECT DISTINCT {key}, unnest(statement_ids) AS sid FROM interactions),
        cand AS (SELECT t.interaction_id, t.user_id, t.item_id, p.sid FROM test t JOIN pool p ON t.{key} = p.{key})"""


def scores_sql(name: str) -> str:
    if name == "random":
        # the order of the hashes as unsigned numbers, by 128-bit arithmetic
        wrap = "% 18446744073709551616"
        return f"""h1 AS (SELECT range AS sid, range::UBIGINT AS x1 FROM range({STATEMENTS})),
            lo AS (SELECT sid, x1::HUGEINT AS v FROM h1), m1 AS (SELECT sid, ((v * (13787848793156543929::HUGEINT % 4294967296) + ((v * (13787848793156543929::HUGEINT // 4294967296)) % 4294967296) * 4294967296) {wrap})::UBIGINT AS z FROM lo),
            x2 AS (SELECT sid, xor(z, z >> 27) AS z FROM m1),
            m2 AS (SELECT sid, (((z % 4294967296)::HUGEINT * 321982955::HUGEINT + (((z % 4294967296)::HUGEINT * 2496678331::HUGEINT + (z >> 32)::HUGEINT * 321982955::HUGEINT) % 4294967296) * 4294967296) {wrap})::UBIGINT AS z FROM x2),
            hashed AS (SELECT sid, xor(z, z >> 31) AS h FROM m2),
            scored AS (SELECT c.*, -(h::HUGEINT) AS score FROM cand c JOIN hashed USING (sid))"""
    owner = {"globalpop": None, "userpop": "user_id", "itempop": "item_id"}[name]
    on = "c.sid = n.sid" + (f" AND c.{owner} = n.{owner}" if owner else "")
    return f"cnt AS ({counts_sql(owner)}), scored AS (SELECT c.*, coalesce(n.cnt, 0) AS score FROM cand c LEFT JOIN cnt n ON {on})"


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY score DESC, sid) AS rank FROM scored), hits AS (SELECT r.interaction_id, r.rank FROM ranked r JOIN pos p ON r.interaction_id = p.interaction_id AND r.sid = p.sid)"


def metric_sql(k: int) -> str:
    return f"""(CASE WHEN count(*) FILTER (rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit{k}, count(*) FILTER (rank <= {k}) / {k}::DOUBLE AS p{k}, count(*) FILTER (rank <= {k}) / count(*)::DOUBLE AS r{k},
        coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda r: 1 / log2(r + 1))) AS ndcg{k}"""


def sample_sql(name: str, paradigm: str, k: int = 10) -> str:
    return f"{DENSE}, {POSITIVES}, {candidates_sql(paradigm)}, {scores_sql(name)}, {RANKED}, samples AS (SELECT interaction_id, count(*) AS n_pos, {metric_sql(k)} FROM hits GROUP BY interaction_id)"


def macro_sql(k: int = 10) -> str:
    return f"SELECT count(*) AS n, {', '.join(f'round(coalesce(avg({m}{k}), 0), 6) AS {m}{k}' for m in ('hit', 'p', 'r', 'ndcg'))} FROM samples"


def _evaluation(name: str, paradigm: str) -> None:
    @query(f"eval_{name}_{paradigm}", f"{sample_sql(name, paradigm)} {macro_sql()}")
    def _(spark, d):
        splits, every, statements = parts(spark, d)
        return evaluate.evaluate(evaluate.ranker_named(name, splits, STATEMENTS), paradigm, splits, every, statements, STATEMENTS)


for _n in ("random", "globalpop", "userpop", "itempop"):
    for _p in ("all", "user", "item"):
        _evaluation(_n, _p)


@query("metrics_pivot", f"SELECT 'itempop' AS method, (SELECT ndcg10 FROM ({sample_sql('itempop', 'item')} {macro_sql()})) AS item, (SELECT ndcg10 FROM ({sample_sql('itempop', 'user')} {macro_sql()})) AS user UNION ALL SELECT 'globalpop', (SELECT ndcg10 FROM ({sample_sql('globalpop', 'item')} {macro_sql()})), (SELECT ndcg10 FROM ({sample_sql('globalpop', 'user')} {macro_sql()}))")
def _(spark, d):
    rows = []
    for name in ("itempop", "globalpop"):
        for paradigm in ("item", "user"):
            rows.append(QUERIES[f"eval_{name}_{paradigm}"][0](spark, d).select(F.lit(name).alias("method"), F.lit(paradigm).alias("paradigm"), "ndcg10"))
    return reduce(DataFrame.unionByName, rows).groupBy("method").pivot("paradigm", ["item", "user"]).agg(F.first("ndcg10"))


def sample_rows(spark, d, name: str, paradigm: str, ks=(10,), given: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Metrics by sample; ``given`` are :func:`parts`, if they are there already."""
    splits, every, statements = given or parts(spark, d)
    found = evaluate.positive_ranks(evaluate.ranker_named(name, splits, STATEMENTS), paradigm, splits, every, statements, STATEMENTS)
    return ranking.ranking_metrics(found, ["interaction_id"], ks)


@query("ranking_metrics", f"{sample_sql('userpop', 'item')} SELECT interaction_id, n_pos, hit10, round(p10, 6) AS p10, round(r10, 6) AS r10, round(ndcg10, 6) AS ndcg10 FROM samples")
def _(spark, d):
    return sample_rows(spark, d, "userpop", "item").select("interaction_id", "n_pos", "hit10", *[F.round(c, 6).alias(c) for c in ("p10", "r10", "ndcg10")])


@query("metrics_macro", f"{sample_sql('itempop', 'user', 5)} {macro_sql(5)}")
def _(spark, d):
    return ranking.macro_average(sample_rows(spark, d, "itempop", "user", (5,)), ["hit5", "p5", "r5", "ndcg5"])


# --- rankings themselves


def _pool_ranking(key: str, name: str, owner: str) -> None:
    sql = f"""{DENSE}, pool AS (SELECT DISTINCT {owner}, unnest(statement_ids) AS sid FROM interactions), cand AS (SELECT * FROM pool), {scores_sql(name)}
        SELECT {owner}, sid, row_number() OVER (PARTITION BY {owner} ORDER BY score DESC, sid) AS rank FROM scored"""

    @query(key, sql)
    def _(spark, d):
        splits, every, _ = parts(spark, d)
        ranker = evaluate.ranker_named(name, splits, STATEMENTS)
        ranked = popularity.rank_within(ranker.score(evaluate.pool(every, owner, STATEMENTS)), [owner])
        return ranked.select(owner, "sid", F.col("rank").cast("bigint").alias("rank"))


_pool_ranking("rank_globalpop", "globalpop", "item_id")
_pool_ranking("rank_userpop", "userpop", "user_id")
_pool_ranking("rank_itempop", "itempop", "item_id")


@query("rank_random", f"WITH cand AS (SELECT range AS sid FROM range({STATEMENTS})), {scores_sql('random')} SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS rank FROM scored")
def _(spark, d):
    return popularity.random_ranks(spark.range(STATEMENTS).select(F.col("id").alias("sid")))


@query("rank_all_globalpop", f"{DENSE}, cnt AS ({counts_sql(None)}), s AS (SELECT r.range AS sid, coalesce(cnt, 0) AS cnt FROM range({STATEMENTS}) r LEFT JOIN cnt ON r.range = cnt.sid) SELECT sid, row_number() OVER (ORDER BY cnt DESC, sid) AS rank FROM s")
def _(spark, d):
    splits, _, statements = parts(spark, d)
    counts = popularity.popularity_counts(splits.where("split = 'train'"), STATEMENTS)
    return popularity.universe_ranks(statements, counts, None, statements).select("sid", F.col("rank").cast("bigint").alias("rank"))


def _scores(key: str, name: str, owner: str) -> None:
    @query(key, f"{DENSE}, cand AS (SELECT DISTINCT {owner}, unnest(statement_ids) AS sid FROM interactions), {scores_sql(name)} SELECT {owner}, sid, score AS cnt FROM scored")
    def _(spark, d):
        splits, every, _ = parts(spark, d)
        scored = evaluate.ranker_named(name, splits, STATEMENTS).score(evaluate.pool(every, owner, STATEMENTS))
        return scored.select(owner, "sid", F.col("score").alias("cnt"))


_scores("global_pop_scores", "globalpop", "item_id")
_scores("user_pop_scores", "userpop", "user_id")
_scores("item_pop_scores", "itempop", "item_id")


@query("topk_per_group", f"{DENSE}, cnt AS ({counts_sql('user_id')}) SELECT user_id, sid, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, sid) AS rank FROM cnt) WHERE rank <= 3")
def _(spark, d):
    counts = popularity.popularity_counts(split_table(spark, d, False).where("split = 'train'"), STATEMENTS, "user_id")
    return popularity.top_k(counts.withColumn("score", F.col("cnt")), ["user_id"], 3).select("user_id", "sid", "cnt", F.col("rank").cast("bigint").alias("rank"))


@query("mask_pos", f"{DENSE}, {POSITIVES}, {candidates_sql('item')} SELECT c.interaction_id, count(*) AS n, count(p.sid) AS n_pos FROM cand c LEFT JOIN pos p ON c.interaction_id = p.interaction_id AND c.sid = p.sid GROUP BY c.interaction_id")
def _(spark, d):
    splits, every, _ = parts(spark, d)
    test = splits.where("split = 'test'")
    cand = test.select("interaction_id", "item_id").join(evaluate.pool(every, "item_id", STATEMENTS), "item_id")
    pos = evaluate.positives(test, STATEMENTS).select("interaction_id", "sid", F.lit(1).alias("is_pos"))
    return cand.join(pos, ["interaction_id", "sid"], "left").groupBy("interaction_id").agg(F.count("*").alias("n"), F.count("is_pos").alias("n_pos"))


@query("idcg_prefix", "SELECT r.range AS n, round(sum(1 / log2(r.range + 1)) OVER (ORDER BY r.range), 6) AS idcg FROM range(1, 21) r")
def _(spark, d):
    return spark.range(1, 21).select(F.col("id").alias("n"), F.round(ranking.ideal_dcg(F.col("id"), 20), 6).alias("idcg"))


# --- offsets, axes, lists

_OFFSETS = f"{DENSE}, o AS (SELECT interaction_id, 8 AS k, len(statement_ids) % 3 AS pos_end, len(statement_ids) % 3 + 1 AS common_end, len(statement_ids) % 3 + 2 AS user_end, len(statement_ids) % 3 + 4 AS item_end, len(statement_ids) % 3 + 5 + interaction_id % 5 AS all_end FROM test)"
_KIND = "CASE WHEN pos < least(pos_end, k) THEN 'pos' WHEN pos < least(common_end, k) THEN 'common' WHEN pos < least(user_end, k) THEN 'user' WHEN pos < least(item_end, k) THEN 'item' WHEN pos < least(all_end, k) THEN 'neg' ELSE 'none' END"


def offsets(spark, d) -> DataFrame:
    test = split_table(spark, d, False).where("split = 'test'")
    base = F.size("statement_ids") % 3
    return test.select("interaction_id", F.lit(8).alias("k"), base.alias("pos_end"), (base + 1).alias("common_end"), (base + 2).alias("user_end"), (base + 4).alias("item_end"), (base + 5 + F.col("interaction_id") % 5).alias("all_end"))


@query("offset_masks", f"{_OFFSETS} SELECT interaction_id, pos::INTEGER AS pos, {_KIND} AS kind FROM o, (SELECT range AS pos FROM range(8))")
def _(spark, d):
    return ranking.offset_masks(offsets(spark, d)).select("interaction_id", "pos", "kind")


@query(
    "metrics_axes",
    f"""{_OFFSETS}, m AS (SELECT interaction_id, pos AS sid, (pos * 7 + interaction_id) % 5 AS score, {_KIND} AS kind FROM o, (SELECT range AS pos FROM range(8))),
    a AS (SELECT *, 'all' AS axis FROM m UNION ALL SELECT *, 'user' FROM m WHERE kind IN ('pos', 'common', 'user') UNION ALL SELECT *, 'item' FROM m WHERE kind IN ('pos', 'common', 'item')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY interaction_id, axis ORDER BY score DESC, sid) AS rank FROM a),
    samples AS (SELECT axis, interaction_id, {metric_sql(3)} FROM ranked WHERE kind = 'pos' GROUP BY axis, interaction_id)
    SELECT axis, count(*) AS n, round(avg(ndcg3), 6) AS ndcg3, round(avg(r3), 6) AS r3 FROM samples GROUP BY axis""",
)
def _(spark, d):
    masks = ranking.offset_masks(offsets(spark, d)).withColumn("sid", F.col("pos")).withColumn("score", (F.col("pos") * 7 + F.col("interaction_id")) % 5).withColumn("is_pos", F.col("kind") == "pos")
    rows = ranking.metrics_by_axis(masks, ["interaction_id"], (3,))
    return rows.groupBy("axis").agg(F.count("*").alias("n"), F.round(F.avg("ndcg3"), 6).alias("ndcg3"), F.round(F.avg("r3"), 6).alias("r3"))


def legacy_sql(truth: str, predicted: str, key: str, value: str, k: int) -> str:
    return f"""tr AS (SELECT DISTINCT {key}, {value} FROM ({truth})), pr AS ({predicted}),
        h AS (SELECT t.{key}, count(*) AS h, sum(1 / ln(rank + 1)) AS g FROM pr p JOIN tr t ON p.{key} = t.{key} AND p.{value} = t.{value} WHERE rank <= {k} GROUP BY t.{key}),
        r AS (SELECT coalesce(g, 0) / list_sum(list_transform(range(1, {k} + 1), lambda i: 1 / ln(i + 1))) AS ndcg, coalesce(h, 0) / {k}::DOUBLE AS p, coalesce(h, 0) / n::DOUBLE AS r FROM (SELECT {key}, count(*) AS n FROM tr GROUP BY {key}) q LEFT JOIN h ON q.{key} = h.{key})
        SELECT round(avg(ndcg), 6) AS ndcg, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM r"""


@query("legacy_exp_metrics", f"{DENSE}, {POSITIVES}, {candidates_sql('item')}, {scores_sql('itempop')}, {RANKED}, {legacy_sql('SELECT interaction_id, sid FROM pos', 'SELECT interaction_id, sid, rank FROM ranked', 'interaction_id', 'sid', 10)}")
def _(spark, d):
    splits, every, statements = parts(spark, d)
    found = evaluate.positive_ranks(evaluate.ranker_named("itempop", splits, STATEMENTS), "item", splits, every, statements, STATEMENTS)
    truth = evaluate.positives(splits.where("split = 'test'"), STATEMENTS)
    return ranking.legacy_list_metrics(found.select("interaction_id", "sid", "rank"), truth, "interaction_id", "sid", 10)


_TOP_ITEMS = "SELECT u.user_id, i.item_id, i.rank FROM (SELECT DISTINCT user_id FROM test) u, (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM train GROUP BY item_id) i WHERE rank <= 10"


@query("legacy_item_metrics", f"{DENSE}, {legacy_sql('SELECT user_id, item_id FROM test', _TOP_ITEMS, 'user_id', 'item_id', 10)}")
def _(spark, d):
    splits = split_table(spark, d, False)
    counts = splits.where("split = 'train'").groupBy("item_id").agg(F.count("*").alias("score"))
    best = counts.orderBy(F.desc("score"), "item_id").limit(10)  # ten rows
    ranked = popularity.rank_within(best.withColumnRenamed("item_id", "sid").withColumn("_one", F.lit(1)), ["_one"]).select(F.col("sid").alias("item_id"), "rank")
    test = splits.where("split = 'test'").select("user_id", "item_id")
    predicted = test.select("user_id").distinct().crossJoin(F.broadcast(ranked))
    return ranking.legacy_list_metrics(predicted, test, "user_id", "item_id", 10)


# --- paired statistics


def both_sql(paradigm: str = "item") -> str:
    one = lambda name: f"(SELECT interaction_id, ndcg10 FROM ({sample_sql(name, paradigm)} SELECT * FROM samples))"
    return f"WITH d AS (SELECT a.interaction_id, a.ndcg10 AS a, b.ndcg10 AS b, a.ndcg10 - b.ndcg10 AS diff FROM {one('userpop')} a JOIN {one('itempop')} b ON a.interaction_id = b.interaction_id)"


def both(spark, d) -> DataFrame:
    """Both rankers' NDCG by sample. Interactions and splits are made once, with the columns that rankings need."""
    every = persist_table(interactions(spark, d).drop("rating"), "interactions")
    given = persist_table(leave_last_two(every).drop("ts"), "splits"), every, spark.range(STATEMENTS).select(F.col("id").alias("sid"))
    a, b = (sample_rows(spark, d, name, "item", given=given) for name in ("userpop", "itempop"))
    return paired_stats.paired(a, b, ["interaction_id"], "ndcg10")


@query("paired_join", f"{both_sql()} SELECT interaction_id, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM d")
def _(spark, d):
    return both(spark, d).select("interaction_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "diff")])


_STATS = "count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(diff), 6) AS mean_diff, round(median(diff), 6) AS median_diff, round(avg(diff) / stddev_samp(diff), 6) AS cohen_d, round(avg(sign(diff)), 6) AS cliffs_delta"


@query("paired_stats", f"{both_sql()} SELECT {_STATS} FROM d")
def _(spark, d):
    s = paired_stats.paired_stats(both(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff", "median_diff", "cohen_d", "cliffs_delta")])


@query("ttest_stat", f"{both_sql()} SELECT count(*) AS n, round(avg(diff) / stddev_samp(diff) * sqrt(count(*)), 5) AS t FROM d")
def _(spark, d):
    return paired_stats.paired_stats(both(spark, d)).select("n", F.round("t", 5).alias("t"))


@query("ttest_p")
def _(spark, d):
    return paired_stats.paired_stats(both(spark, d)).select("n", F.round(paired_stats.t_test_p(F.col("t"), F.col("n")), 6).alias("p"))


@query(
    "wilcoxon_w",
    f"""{both_sql()}, s AS (SELECT round(abs(diff), 12) AS m, diff > 0 AS up FROM d WHERE diff <> 0), r AS (SELECT up, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rk FROM s)
    SELECT count(*) AS n, least(sum(rk) FILTER (up), sum(rk) FILTER (NOT up))::DOUBLE AS w FROM r""",
)
def _(spark, d):
    return paired_stats.wilcoxon(both(spark, d)).select("n", "w")


@query("sig_label", "SELECT p_partkey, CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' ELSE 'ns' END AS label FROM (SELECT p_partkey, (p_partkey % 97) / 970.0 AS p FROM part)")
def _(spark, d):
    p = (F.col("p_partkey") % 97) / 970.0
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", paired_stats.significance_label(p).alias("label"))
