"""Relational parts of the models, trainers, and inference behind stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.catalog.scans import split_table
from explainkit.functions import models
from explainkit.functions.vectors import yes_probability
from explainkit.operators import factors
from explainkit.plans.adapters import SPLITS_SQL, STATEMENTS, interactions_sql, read, reviews
from explainkit.plans.storage import persist_table

QUERIES: dict = {}
DENSE = f"WITH {interactions_sql()}, {SPLITS_SQL}, train AS (SELECT * FROM splits WHERE split = 'train'), each AS (SELECT user_id, item_id, unnest(statement_ids) AS sid FROM train)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def train(spark, d) -> DataFrame:
    return split_table(spark, d, False).where("split = 'train'")


@query("exp_bias", f"{DENSE} SELECT sid, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM each)::DOUBLE - (SELECT count(*) FROM each)::DOUBLE / ((SELECT count(DISTINCT user_id) FROM each) * (SELECT count(DISTINCT sid) FROM each)), 6) AS bias FROM each GROUP BY sid")
def _(spark, d):
    return factors.explanation_bias(train(spark, d), "user_id").select("sid", F.round("bias", 6).alias("bias"))


_EDGES = f"{DENSE}, edges AS (SELECT user_id AS r, sid AS c, count(*) AS w FROM each GROUP BY 1, 2)"


@query("ui_tag_matrix", f"{_EDGES} SELECT r, c, w FROM edges")
def _(spark, d):
    return factors.tag_matrix(train(spark, d), "user_id")


_NORM = f"{_EDGES}, dr AS (SELECT r, sum(w) + 1e-7 AS d FROM edges GROUP BY r), dc AS (SELECT c, sum(w) + 1e-7 AS d FROM edges GROUP BY c), norm AS (SELECT e.r, e.c, w / sqrt(dr.d * dc.d) AS w FROM edges e JOIN dr ON e.r = dr.r JOIN dc ON e.c = dc.c)"


@query("norm_adj", f"{_NORM} SELECT r, c, round(w, 6) AS w FROM norm")
def _(spark, d):
    return factors.normalized_adjacency(factors.tag_matrix(train(spark, d), "user_id")).select("r", "c", F.round("w", 6).alias("w"))


@query(
    "gcn_propagate",
    f"""{_NORM}, u0 AS (SELECT DISTINCT r AS id, (r % 7) / 7.0::DOUBLE AS x FROM edges), s0 AS (SELECT DISTINCT c AS id, (c % 5) / 5.0::DOUBLE AS x FROM edges),
    u1 AS (SELECT r AS id, sum(w * x) AS x FROM norm JOIN s0 ON c = id GROUP BY r), s1 AS (SELECT c AS id, sum(w * x) AS x FROM norm JOIN u0 ON r = id GROUP BY c),
    u2 AS (SELECT r AS id, sum(w * x) AS x FROM norm JOIN s1 ON c = id GROUP BY r)
    SELECT u0.id, round((u0.x + u1.x + u2.x) / 3, 6) AS x FROM u0 JOIN u1 ON u0.id = u1.id JOIN u2 ON u0.id = u2.id""",
)
def _(spark, d):
    adjacency = persist_table(factors.normalized_adjacency(factors.tag_matrix(train(spark, d), "user_id")), "adjacency")
    start = lambda c, n: adjacency.select(F.col(c).alias("id")).distinct().select("id", F.array((F.col("id") % n) / float(n)).alias("v"))
    users, _ = factors.propagate(adjacency, start("r", 7), start("c", 5), 2)
    return users.select("id", F.round(F.col("v")[0], 6).alias("x"))


@query("rec_exclude_seen", f"{DENSE}, s AS (SELECT DISTINCT user_id FROM train WHERE user_id % 50 = 0), i AS (SELECT item_id, count(*) AS score FROM train GROUP BY item_id) SELECT user_id, item_id, rank FROM (SELECT s.user_id, i.item_id, row_number() OVER (PARTITION BY s.user_id ORDER BY score DESC, i.item_id) AS rank FROM s, i WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = i.item_id)) WHERE rank <= 5")
def _(spark, d):
    """Popular items for every fiftieth user: the stated query set."""
    t = train(spark, d)
    items = t.groupBy("item_id").agg(F.count("*").alias("score"))
    scored = t.select("user_id").distinct().where("user_id % 50 = 0").crossJoin(items)
    return factors.exclude_seen(scored, t, "user_id", "item_id", 5).select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


HASH52 = "('0x' || substr(md5({}), 1, 13))::BIGINT"


@query(
    "neg_sample_anti",
    f"""{DENSE}, pos AS (SELECT DISTINCT user_id, sid FROM each), dr AS (SELECT user_id, sid, t.range AS try, {HASH52.format("user_id || ',' || sid || ',' || t.range || ',0'")} % {STATEMENTS} AS negative FROM pos, range(1, 17) t),
    fresh AS (SELECT * FROM dr WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = dr.user_id AND p.sid = dr.negative)), first AS (SELECT user_id, sid, arg_min(negative, try) AS negative FROM fresh GROUP BY 1, 2),
    low AS (SELECT u.user_id, min(r.range) AS negative FROM (SELECT DISTINCT user_id FROM pos) u, range({STATEMENTS}) r WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = u.user_id AND p.sid = r.range) GROUP BY 1)
    SELECT user_id, sid, negative FROM first UNION ALL SELECT p.user_id, p.sid, low.negative FROM pos p LEFT JOIN low USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.user_id = p.user_id AND f.sid = p.sid)""",
)
def _(spark, d):
    pos = train(spark, d).select("user_id", F.explode("statement_ids").alias("sid"))
    return factors.negative_samples(pos, "user_id", "sid", STATEMENTS)


@query(
    "tag_neg_sampler",
    f"""{DENSE}, k AS (SELECT interaction_id, statement_ids, list_filter(list_transform(range(0, 40), lambda j: {HASH52.format("interaction_id || ',' || j || ',0'")} % {STATEMENTS}), lambda x: NOT list_contains(statement_ids, x))[1:20] AS kept FROM train)
    SELECT interaction_id, array_to_string(list_concat(kept, list_filter(range(0, {STATEMENTS}), lambda x: NOT list_contains(statement_ids, x))[1:20 - len(kept)]), ',') AS negatives FROM k""",
)
def _(spark, d):
    t = train(spark, d)
    drawn = factors.tag_negatives(F.col("interaction_id"), F.col("statement_ids"), 20, STATEMENTS)
    return t.select("interaction_id", F.array_join(drawn, ",").alias("negatives"))


@query("mu_blend", "SELECT p_partkey, mu::DOUBLE AS mu, round(mu::DOUBLE * p_size + (1 - mu::DOUBLE) * p_retailprice, 6) AS score FROM part, (VALUES (0.0), (0.5), (0.7), (1.0)) m(mu)")
def _(spark, d):
    grid = F.explode(F.array(*map(F.lit, (0.0, 0.5, 0.7, 1.0)))).alias("mu")
    rows = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", grid)
    return rows.select("p_partkey", "mu", F.round(factors.blend(F.col("p_size"), F.col("p_retailprice"), F.col("mu")), 6).alias("score"))


@query("yes_prob", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(l_tax * 10 - l_discount * 10)), 6) AS p FROM lineitem")
def _(spark, d):
    p = yes_probability(F.col("l_discount") * 10, F.col("l_tax") * 10)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


@query("bpr_loss", "SELECT round(avg(-ln(1 / (1 + exp(-(l_discount - l_tax) * 10)))), 6) AS loss FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").agg(F.round(F.avg(factors.bpr_loss(F.col("l_discount") * 10, F.col("l_tax") * 10)), 6).alias("loss"))


@query(
    "masked_bpr",
    """WITH r AS (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_quantity > 10 THEN -ln(1 / (1 + exp(-(l_discount - l_tax) * 10))) ELSE 0 END AS t, l_quantity > 10 AS m FROM lineitem),
    s AS (SELECT pos, t / greatest(1, count(*) FILTER (m) OVER (PARTITION BY l_orderkey)) AS t FROM r), a AS (SELECT avg(t) AS t FROM s GROUP BY pos) SELECT round(sum(t), 6) AS loss FROM a""",
)
def _(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") * 10).alias("positive"), (F.col("l_tax") * 10).alias("negative"), (F.col("l_quantity") > 10).alias("mask"))
    return factors.masked_bpr(rows).select(F.round("loss", 6).alias("loss"))


def _factors(spark, d, alpha: float) -> DataFrame:
    """The best statements of every user by factors trained on all training interactions."""
    users, statements, _ = factors.user_factors(train(spark, d), STATEMENTS, dim=8, rate=0.05, epochs=2, alpha=alpha)
    return factors.best_statements(users, statements, 10)


@query("bper_topk")
def _(spark, d):
    return _factors(spark, d, 0.0)


@query("bperj_topk")
def _(spark, d):
    return _factors(spark, d, 1.0)


def asked(spark, d) -> DataFrame:
    return reviews(spark, d).select("row_id", "review", F.substring("review", 1, 20).alias("review_title"))


@query("llm_extract")
def _(spark, d):
    found = models.extract_statements(asked(spark, d), models.SentenceExtractor())
    return found.select("row_id", F.to_json("statements").alias("statements"))


@query("llm_verify")
def _(spark, d):
    found = models.verify_statements(models.extract_statements(asked(spark, d), models.SentenceExtractor()), models.RuleVerifier())
    return found.select("row_id", F.size("cleaned.statements").alias("n"))


_HAS = r"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({})($|[^\p{{L}}\p{{N}}_])')"


@query(
    "llm_judge",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\S') THEN (NOT ({_HAS.format("and|but|or|because|while")} OR contains(text, ';')))::INTEGER END AS atomicity,
    CASE WHEN regexp_matches(text, '\\S') THEN (NOT {_HAS.format("i|me|my|we|us|our")})::INTEGER END AS explainatoriness FROM conversations""",
)
def _(spark, d):
    found = models.judge_texts(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", models.ClauseJudge())
    return found.select("conv_id", "turn", "verdict.atomicity", "verdict.explainatoriness")


@query("embed_texts")
def _(spark, d):
    found = models.encode_column(read(spark, d, "benchmark"), "text", models.HashedEncoder())
    return found.select("item_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), ",").alias("embedding"))


_SETS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    "rerank_pairs",
    f"""WITH p AS (SELECT a.item_id, {_SETS.format("a.text")} AS x, {_SETS.format("b.text")} AS y FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id - 1)
    SELECT item_id, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0 END, 6) AS sim FROM p""",
)
def _(spark, d):
    a = read(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return models.score_pairs(a.join(b, "item_id"), "a", "b", models.JaccardScorer()).select("item_id", F.round("cross_encoder_sim", 6).alias("sim"))
