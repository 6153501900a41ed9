"""Files written and read back, samples, batches, views and small measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.catalog.clustering import COMPONENTS, KNN, MEMBERS, members, neighbours
from explainkit.catalog.ranking import DENSE as RANK_DENSE
from explainkit.catalog.ranking import both, both_sql, counts_sql
from explainkit.catalog.scans import DENSE, SPARSE, split_table
from explainkit.functions import text
from explainkit.operators import paired_stats, popularity, samples
from explainkit.plans.adapters import REVIEWS_SQL, SPLITS_SQL, STATEMENTS, VECTORS_SQL, interactions, read, reviews, vectors
from explainkit.plans.storage import drop_path, fresh_path, persist_path, persist_table
from explainkit.sources import artifacts

QUERIES: dict = {}
H52 = "('0x' || substr(md5({}), 1, 13))::BIGINT"
_DRAW, _ORDER = H52.format("event_id || ',7'"), H52.format("event_id || ',3'")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


@query("src_neighbours", f"{KNN} SELECT src, rank, dst, round(sim, 6) AS sim FROM near WHERE rank <= 4")
def _(spark, d):
    """Neighbour lists as an archive of arrays and back; ids are the rows."""
    near = neighbours(spark, d, 4).select("src", "rank", "dst", "sim")
    path = f"{fresh_path(spark, 'archive')}/near.npz"
    rows = vectors(spark, d).agg(F.max("id")).first()[0] + 1
    artifacts.write_neighbours(near, path, rows, 4)
    found = artifacts.read_neighbours(spark, path)
    return found.select("src", F.col("rank").cast("bigint").alias("rank"), "dst", F.round("sim", 6).alias("sim"))


_POOL = f"{DENSE}, p AS (SELECT row_number() OVER (ORDER BY interaction_id) - 1 AS interaction_id, statement_ids FROM interactions)"


def _artifacts(spark, d) -> DataFrame:
    from explainkit.operators.dictionary import dense_ids

    rows, place = persist_path(dense_ids(interactions(spark, d).select(F.col("interaction_id").alias("old"), "statement_ids"), ["old"], "interaction_id").select("interaction_id", F.col("statement_ids").cast("array<long>").alias("pool")), "pools")
    size = F.size("pool")
    rows = rows.withColumn("offsets", F.array(*[F.least(size, F.lit(k)) for k in (1, 2, 3, 5, 8)])).withColumn("negatives", F.array(*[size] * 4))
    folder, (n, width) = fresh_path(spark, "artefacts"), rows.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0))).first()
    artifacts.write_artifacts(rows, folder, n, width)
    drop_path(spark, place)
    return artifacts.read_artifacts(spark, folder, n, width)


@query("src_artifacts", f"{_POOL}, q AS (SELECT interaction_id, unnest(statement_ids) AS sid, generate_subscripts(statement_ids, 1) - 1 AS pos FROM p) SELECT interaction_id, pos::INTEGER AS pos, sid FROM q")
def _(spark, d):
    """Sampled candidates through their array files, in long form."""
    return artifacts.pool_rows(_artifacts(spark, d))


@query("slice_artifacts", f"{_POOL} SELECT interaction_id, least(len(statement_ids), 3)::INTEGER AS user_end FROM p WHERE interaction_id % 50 = 0")
def _(spark, d):
    found = _artifacts(spark, d)
    wanted = found.select("interaction_id").where("interaction_id % 50 = 0")
    return artifacts.slice_rows(found, wanted).select("interaction_id", F.col("offsets")[2].alias("user_end"))


@query("src_splits", f"{SPARSE}, {SPLITS_SQL} SELECT interaction_id, split FROM splits")
def _(spark, d):
    folder = fresh_path(spark, "splits")
    artifacts.write_splits(split_table(spark, d), folder)
    return artifacts.read_splits(spark, folder)


@query("row_vectors", f"WITH {VECTORS_SQL} SELECT id, round(list_sum(v), 4) AS total FROM vectors")
def _(spark, d):
    """Vectors through an array file, joined to their table by row number."""
    from explainkit.operators.dictionary import dense_ids

    v = persist_table(dense_ids(vectors(spark, d).select("id", "embedding"), ["id"], "row"), "rows")
    path = f"{fresh_path(spark, 'array')}/vectors.npy"
    width = v.select(F.size("embedding")).first()[0]
    artifacts.write_npy(v.select("row", F.col("embedding").alias("values")), path, v.count(), width)
    joined = artifacts.join_rows(v.select("id", "row"), artifacts.read_npy(spark, path, width), "row")
    return joined.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("sink_csv", f"{DENSE} SELECT interaction_id, rating::DOUBLE AS rating, array_to_string(statement_ids, ',') AS ids FROM interactions")
def _(spark, d):
    """Interactions as CSV with list literals, read back."""
    from explainkit.functions.json_text import parse_int_list

    path = fresh_path(spark, "csv")
    artifacts.write_table(interactions(spark, d).select("interaction_id", "rating", "statement_ids"), path, "csv")
    back = spark.read.schema("interaction_id long, rating double, statement_ids string").option("header", "true").option("escape", '"').csv(path)
    return back.select("interaction_id", "rating", F.array_join(parse_int_list(F.col("statement_ids")), ",").alias("ids"))


@query("sink_json", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path = fresh_path(spark, "json")
    artifacts.write_table(read(spark, d, "events").select("event_id", "event_type"), path, "json")
    return spark.read.schema("event_id long, event_type string").json(path)


@query("settings", "SELECT 'model' AS key, 'gcn' AS value UNION ALL SELECT 'train.epochs', '5' UNION ALL SELECT 'train.ks', '[1, 10]' UNION ALL SELECT 'train.rate', '0.1'")
def _(spark, d):
    """A settings file merged over defaults, a prompt file read whole."""
    path = fresh_path(spark, "settings")
    spark.createDataFrame([("# settings\nmodel: gcn\ntrain:\n  epochs: 5  # few\n  ks: [1, 10]\n  seed: null\n",)], "value string").coalesce(1).write.text(path)
    merged = artifacts.merge_settings({"model": "mf", "train": {"rate": 0.1, "epochs": 100, "seed": 1}}, artifacts.read_settings(spark, path))
    flat = lambda x, at="": [r for k, v in x.items() for r in (flat(v, f"{at}{k}.") if isinstance(v, dict) else [(at + k, str(v))])]
    return spark.createDataFrame(flat(merged), "key string, value string")


@query("uniform_sample", f"SELECT event_id, event_type FROM events ORDER BY {_DRAW}, event_id LIMIT 100")
def _(spark, d):
    return samples.uniform_sample(read(spark, d, "events").select("event_id", "event_type"), "event_id", 100, 7)


@query("epoch_order", f"SELECT event_id, row_number() OVER (ORDER BY {_ORDER}, event_id) - 1 AS at FROM events")
def _(spark, d):
    return samples.epoch_order(read(spark, d, "events").select("event_id"), "event_id", 3)


@query("batches", "SELECT batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch FROM events) GROUP BY batch")
def _(spark, d):
    found = samples.batches(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 64)
    return found.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("page", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 120")
def _(spark, d):
    return samples.page(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 120, 50).select("event_id")


@query("item_user_sets", f"{DENSE} SELECT item_id, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM interactions GROUP BY item_id")
def _(spark, d):
    sets = samples.owner_sets(interactions(spark, d), "item_id", "user_id")
    return sets.select("item_id", F.array_join("members", ",").alias("users"))


@query("sentiment_codes", f"WITH {REVIEWS_SQL} SELECT row_id, CASE sentiment WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS code, sentiment AS name FROM reviews")
def _(spark, d):
    rows = reviews(spark, d).select("row_id", text.sentiment_code(F.concat(F.lit(" "), F.initcap("sentiment"))).alias("code"))
    return rows.withColumn("name", text.sentiment_name(F.col("code")))


_KINDS = f"""WITH {REVIEWS_SQL}, l AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(review, '[:,?!\\n.]'), lambda x: trim(x, ' \t\r\n')), lambda x: x <> '') AS l FROM reviews),
    s AS (SELECT row_id, unnest(l) AS exp, generate_subscripts(l, 1) - 1 AS pos FROM l), w AS (SELECT row_id, pos, list_filter(regexp_split_to_array(lower(exp), '\\s+'), lambda x: x <> '') AS w FROM s),
    b AS (SELECT row_id, pos, w, list_transform(w, lambda x: regexp_replace(x, '[^a-z'']', '', 'g')) AS b FROM w),
    k AS (SELECT row_id, pos, len(w) AS word_num, len(list_filter(w, lambda x: x IN ({", ".join(map(repr, text.SUBJECT_WORDS))}))) AS subj_num,
        list_transform(b, lambda x: CASE WHEN x = '' OR x IN ({", ".join(map(repr, text.FUNCTION_WORDS + text.SUBJECT_WORDS))}) THEN 'other' WHEN x IN ({", ".join(map(repr, text.ADJECTIVES))}) OR regexp_matches(x, '{text.ADJECTIVE_ENDINGS}') THEN 'adj' ELSE 'noun' END) AS k FROM b),
    c AS (SELECT row_id, pos::INTEGER AS pos, word_num::INTEGER AS word_num, subj_num::INTEGER AS subj_num, len(list_filter(k, lambda x: x = 'noun'))::INTEGER AS noun_num, len(list_filter(k, lambda x: x = 'adj'))::INTEGER AS adj_num FROM k)"""


@query("sentence_quality", f"{_KINDS} SELECT * FROM c WHERE word_num >= 2 AND subj_num = 0 AND noun_num >= 1 AND adj_num >= 1")
def _(spark, d):
    s = reviews(spark, d).select("row_id", F.posexplode(text.sentences(F.col("review"))).alias("pos", "exp"))
    return s.select("row_id", "pos", *text.sentence_counts(F.col("exp"))).where(text.good_sentence())


_MASKED = f"{RANK_DENSE}, cnt AS ({counts_sql('item_id')}), cand AS (SELECT DISTINCT item_id, unnest(statement_ids) AS sid FROM interactions)"


@query("masked_scores", f"{_MASKED}, s AS (SELECT c.item_id, c.sid, cnt FROM cand c LEFT JOIN cnt n ON c.item_id = n.item_id AND c.sid = n.sid), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cnt DESC NULLS LAST, sid) AS rank FROM s) SELECT item_id, sid, rank FROM r")
def _(spark, d):
    splits = split_table(spark, d, False)
    counts = popularity.popularity_counts(splits.where("split = 'train'"), STATEMENTS, "item_id").withColumnRenamed("cnt", "score")
    pool = interactions(spark, d).select("item_id", F.explode("statement_ids").alias("sid")).distinct()
    ranked = popularity.rank_within(samples.masked_scores(pool, counts, ["item_id", "sid"]), ["item_id"])
    return ranked.select("item_id", "sid", F.col("rank").cast("bigint").alias("rank"))


@query("scatter_ranks", f"{RANK_DENSE}, cnt AS ({counts_sql('user_id')}) SELECT user_id, pos, sid FROM (SELECT user_id, sid, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, sid) - 1 AS pos FROM cnt) WHERE pos < 4")
def _(spark, d):
    counts = popularity.popularity_counts(split_table(spark, d, False).where("split = 'train'"), STATEMENTS, "user_id")
    ranked = popularity.rank_within(counts.withColumnRenamed("cnt", "score"), ["user_id"])
    return samples.scatter_ranks(ranked, "user_id", 4).select("user_id", F.col("pos").cast("bigint").alias("pos"), "sid")


_LISTS = f"{COMPONENTS}, l AS (SELECT component AS cluster_id, min(id) AS rep, list(id ORDER BY id) AS members FROM comp GROUP BY component)"


def _lists(spark, d) -> DataFrame:
    from explainkit.catalog.clustering import components

    every = components(spark, d)[0]
    return every.groupBy(F.col("component").alias("cluster_id")).agg(F.min("id").alias("rep"), F.collect_list("id").alias("members"))


@query("cluster_table", f"{_LISTS} SELECT cluster_id, lang AS sentiment, rep AS representative_index, text AS representative_statement, len(members)::INTEGER AS cluster_size, array_to_string(members, ',') AS member_indices FROM l JOIN documents ON doc_id = rep")
def _(spark, d):
    said = read(spark, d, "documents").select(F.col("doc_id").alias("statement_id"), F.col("text").alias("statement"), F.col("lang").alias("sentiment"))
    table = samples.cluster_table(_lists(spark, d), said)
    return table.withColumn("member_indices", F.array_join("member_indices", ","))


@query("representative_vectors", f"{_LISTS} SELECT cluster_id, round(v[1], 5) AS first FROM l JOIN vectors ON id = rep")
def _(spark, d):
    found = samples.representative_vectors(_lists(spark, d), vectors(spark, d))
    return found.select("cluster_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("neighbour_view", f"{KNN} SELECT src AS id, rank, dst, round(list_dot_product(a.v, b.v), 6) AS sim FROM near JOIN vectors a ON a.id = src JOIN vectors b ON b.id = dst WHERE rank <= 3 AND src % 50 = 0")
def _(spark, d):
    asked = vectors(spark, d).where("id % 50 = 0").select("id")
    found = samples.neighbour_view(vectors(spark, d), neighbours(spark, d, 3), asked, 3)
    return found.select("id", F.col("rank").cast("bigint").alias("rank"), "dst", F.round("sim", 6).alias("sim"))


@query("plane_coordinates")
def _(spark, d):
    """Plane coordinates of a sample of vectors: the data of a scatter plot."""
    return samples.plane_coordinates(vectors(spark, d), "id", most=300, rounds=60)


@query("cluster_moments", f"{MEMBERS}, e AS (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM members), s AS (SELECT cluster_id, d, sum(x) AS x FROM e GROUP BY 1, 2) SELECT s.cluster_id, any_value(m) AS m, round(sum(x * x), 4) AS s2 FROM s JOIN (SELECT cluster_id, count(*) AS m FROM members GROUP BY 1) z ON s.cluster_id = z.cluster_id GROUP BY s.cluster_id")
def _(spark, d):
    from explainkit.operators.clusters import second_moments

    return second_moments(members(spark, d)).select("cluster_id", "m", F.round("s2", 4).alias("s2"))


@query(
    "wilcoxon_p",
    f"""{both_sql()}, s AS (SELECT round(abs(diff), 12) AS m, diff > 0 AS up FROM d WHERE diff <> 0), r AS (SELECT m, up, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rk FROM s),
    t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM s GROUP BY m)), w AS (SELECT count(*)::DOUBLE AS n, least(sum(rk) FILTER (up), sum(rk) FILTER (NOT up))::DOUBLE AS w FROM r),
    z AS (SELECT n, abs((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) / sqrt(2.0) AS x FROM w, t), k AS (SELECT n, x, 1 / (1 + 0.5 * x) AS t FROM z)
    SELECT n::BIGINT AS n, round(t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))), 5) AS p FROM k""",
)
def _(spark, d):
    return paired_stats.wilcoxon(both(spark, d)).select("n", F.round("p", 5).alias("p"))
