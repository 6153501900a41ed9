"""Scans, shards, filters, splits, dictionaries and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.functions.json_text import parse_int_list
from explainkit.operators import dictionary, splits
from explainkit.operators.popularity import statement_sets, valid_ids
from explainkit.plans.adapters import REVIEWS_SQL, SPLITS_SQL, STATEMENTS, VECTORS_SQL, interactions, interactions_sql, read, reviews, vectors
from explainkit.plans.storage import persist_table
from explainkit.sources import atomic
from explainkit.sources import reviews as files

QUERIES: dict = {}
DENSE, SPARSE = f"WITH {interactions_sql()}", f"WITH {interactions_sql(True)}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def split_table(spark, d, sparse: bool = True) -> DataFrame:
    return splits.leave_last_two(interactions(spark, d, sparse))


def lists(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.array_join(column, ",").alias("ids"))


@query("leave_last_2", f"{SPARSE}, {SPLITS_SQL} SELECT interaction_id, split FROM splits")
def _(spark, d):
    return split_table(spark, d).select("interaction_id", "split")


@query(
    "split_meta",
    f"""{SPARSE}, {SPLITS_SQL} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'eval') AS eval, count(*) FILTER (split = 'test') AS test,
    count(DISTINCT CASE WHEN split = 'train' THEN user_id END) AS users, count(DISTINCT CASE WHEN split = 'train' THEN item_id END) AS items FROM splits""",
)
def _(spark, d):
    return splits.split_meta(split_table(spark, d))


@query("sorted_pos", f"{DENSE} SELECT interaction_id, row_number() OVER (ORDER BY user_id, ts, interaction_id) - 1 AS sorted_pos FROM interactions")
def _(spark, d):
    return splits.sorted_positions(interactions(spark, d).select("user_id", "ts", "interaction_id")).select("interaction_id", "sorted_pos")


@query("warm_start_semi", f"{SPARSE}, {SPLITS_SQL} SELECT split, count(*) AS n FROM splits WHERE split <> 'train' GROUP BY split")
def _(spark, d):
    return split_table(spark, d).where("split <> 'train'").groupBy("split").agg(F.count("*").alias("n"))


@query("user_test_items", f"{SPARSE}, {SPLITS_SQL} SELECT user_id, string_agg(DISTINCT item_id::VARCHAR, ',') AS items FROM splits WHERE split = 'test' GROUP BY user_id")
def _(spark, d):
    return split_table(spark, d).where("split = 'test'").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"))


@query("tuples_by_split", f"{SPARSE}, {SPLITS_SQL} SELECT interaction_id, split, user_id, item_id, array_to_string(statement_ids, ',') AS ids FROM splits")
def _(spark, d):
    return split_table(spark, d).select("interaction_id", "split", "user_id", "item_id", F.array_join("statement_ids", ",").alias("ids"))


@query("known_ui_semi", f"{SPARSE}, {SPLITS_SQL} SELECT interaction_id FROM cut WHERE split = 'test' AND user_id IN (SELECT user_id FROM cut WHERE split = 'train') AND item_id IN (SELECT item_id FROM cut WHERE split = 'train')")
def _(spark, d):
    cut = splits.leave_last_two(interactions(spark, d, True), warm_start=False)
    train = cut.where("split = 'train'")
    test = cut.where("split = 'test'")
    for key in ("user_id", "item_id"):
        test = test.join(train.select(key).distinct(), key, "left_semi")
    return test.select("interaction_id")


@query("scan_rename", "SELECT o_totalprice AS rating, o_custkey AS user_id, o_orderkey AS item_id FROM orders")
def _(spark, d):
    raw = read(spark, d, "orders").selectExpr("o_totalprice AS overall", "o_custkey AS reviewerID", "o_orderkey AS asin")
    return files.renamed(raw)


@query("src_jsonl", f"WITH {REVIEWS_SQL} SELECT row_id::DOUBLE AS rating, row_id AS timestamp, review, sentiment AS user_name, row_id::VARCHAR AS user_id, row_id::VARCHAR AS item_id, substr(review, 1, 20) AS review_title FROM reviews")
def _(spark, d):
    """Reviews written as JSON lines and read back through the explicit schema."""
    from explainkit.plans.storage import fresh_path

    path = fresh_path(spark, "reviews")
    raw = reviews(spark, d).selectExpr("cast(row_id AS double) AS overall", "row_id AS unixReviewTime", "review AS reviewText", "sentiment AS reviewerName", "cast(row_id AS string) AS reviewerID", "cast(row_id AS string) AS asin", "substring(review, 1, 20) AS summary")
    raw.write.json(path)
    return files.read_reviews(spark, path)


@query("validate_schema", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    docs = files.require_columns(read(spark, d, "documents"), ["doc_id", "text"], "documents")
    return docs.agg(F.count("*").alias("n"))


@query("embedding_shape", "SELECT count(*) AS n, min(len(embedding))::BIGINT AS low, max(len(embedding))::BIGINT AS high FROM embeddings")
def _(spark, d):
    e = read(spark, d, "embeddings")
    files.require_vectors(e)
    return e.agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("bigint").alias("low"), F.max(F.size("embedding")).cast("bigint").alias("high"))


@query("parse_int_list", f"{DENSE} SELECT interaction_id, list_sum(statement_ids)::BIGINT AS total, len(statement_ids)::BIGINT AS n FROM interactions")
def _(spark, d):
    literal = F.concat(F.lit("["), F.array_join("statement_ids", ", "), F.lit("]"))
    ids = parse_int_list(literal)
    return interactions(spark, d).select("interaction_id", F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size(ids).cast("bigint").alias("n"))


@query("json_map_explode", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")))


@query("union_shards", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    e = read(spark, d, "events")
    parts = [files.shard(e, "event_id", 3, r).withColumn("rank", F.lit(r)) for r in range(3)]
    return files.union_shards(parts).groupBy("event_type").agg(F.count("*").alias("n"))


@query("shard_mod", "SELECT event_id FROM events WHERE event_id % 4 = 1")
def _(spark, d):
    return files.shard(read(spark, d, "events"), "event_id", 4, 1).select("event_id")


@query("shard_range", "SELECT event_id, (event_id // (greatest(1, ceil(ceil((SELECT count(*) FROM events) / 64.0) / 4.0))::BIGINT * 64))::INTEGER AS shard FROM events")
def _(spark, d):
    e = read(spark, d, "events")
    return files.shard_ranges(e, "event_id", 64, 4, e.count()).select("event_id", "shard")


@query("resume_anti", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _(spark, d):
    e = read(spark, d, "events")
    return files.resume(e, e.where("event_type = 'error'").distinct(), "user_id").select("event_id")


@query("dropna_subset", "SELECT p_brand, count(*) AS n FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey WHERE l_partkey IS NOT NULL GROUP BY p_brand")
def _(spark, d):
    hot = read(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    joined = read(spark, d, "part").join(hot, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.dropna(subset=["l_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("id_range_filter", f"{DENSE} SELECT interaction_id, array_to_string(list_distinct_kept, ',') AS ids FROM (SELECT interaction_id, list_filter(statement_ids, lambda x: x BETWEEN 0 AND 249) AS list_distinct_kept FROM interactions)")
def _(spark, d):
    return interactions(spark, d).select("interaction_id", F.array_join(F.filter("statement_ids", lambda x: x.between(0, 249)), ",").alias("ids"))


@query("group_having", "SELECT l_suppkey AS cluster_id, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600")
def _(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cluster_id")).agg(F.count("*").alias("n")).where("n >= 600")


@query("list_truncate", f"{DENSE} SELECT interaction_id, array_to_string(statement_ids[1:2], ',') AS ids FROM interactions")
def _(spark, d):
    return interactions(spark, d).select("interaction_id", F.array_join(F.slice("statement_ids", 1, 2), ",").alias("ids"))


@query("atomic_inter", f"{SPARSE}, {SPLITS_SQL} SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, rating::DOUBLE AS rating, array_to_string(statement_ids, ',') AS tag FROM splits")
def _(spark, d):
    return atomic.inter_rows(split_table(spark, d))


@query("atomic_users", f"{SPARSE}, {SPLITS_SQL} SELECT DISTINCT user_id::VARCHAR AS user_id FROM splits ORDER BY 1")
def _(spark, d):
    return atomic.id_rows(split_table(spark, d), "user_id")


@query("user_stmt_sets", f"{DENSE} SELECT user_id, array_to_string(list_sort(list(DISTINCT sid)), ',') AS ids FROM (SELECT user_id, unnest(statement_ids) AS sid FROM interactions) GROUP BY user_id")
def _(spark, d):
    return lists(statement_sets(interactions(spark, d), "user_id", STATEMENTS), "user_id", "sids")


@query("item_stmt_sets", f"{DENSE} SELECT item_id, array_to_string(list_sort(list(DISTINCT sid)), ',') AS ids FROM (SELECT item_id, unnest(statement_ids) AS sid FROM interactions) GROUP BY item_id")
def _(spark, d):
    return lists(statement_sets(interactions(spark, d), "item_id", STATEMENTS), "item_id", "sids")


@query("stmt_set_stats", f"{DENSE}, s AS (SELECT user_id, count(DISTINCT sid) AS n FROM (SELECT user_id, unnest(statement_ids) AS sid FROM interactions) GROUP BY user_id) SELECT round(avg(n), 6) AS mean, min(n)::BIGINT AS low, max(n)::BIGINT AS high FROM s")
def _(spark, d):
    sets = statement_sets(interactions(spark, d), "user_id", STATEMENTS).select(F.size("sids").alias("n"))
    return sets.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").cast("bigint").alias("low"), F.max("n").cast("bigint").alias("high"))


@query("ground_truth", f"{SPARSE}, {SPLITS_SQL} SELECT interaction_id, array_to_string(list_sort(list_distinct(statement_ids)), ',') AS ids FROM splits WHERE split = 'test'")
def _(spark, d):
    test = split_table(spark, d).where("split = 'test'")
    return test.select("interaction_id", F.array_join(F.array_sort(valid_ids(F.col("statement_ids"), STATEMENTS)), ",").alias("ids"))


_FIRST = f"{DENSE}, m AS (SELECT user_id, row_number() OVER (ORDER BY min(interaction_id)) - 1 AS idx FROM interactions GROUP BY user_id)"


@query("id_map_first_seen", f"{_FIRST} SELECT user_id, idx FROM m")
def _(spark, d):
    return dictionary.id_map_first_seen(interactions(spark, d), "user_id", "interaction_id")


@query("id_map_roundtrip", f"{_FIRST} SELECT interaction_id, i.user_id, idx FROM interactions i JOIN m ON i.user_id = m.user_id")
def _(spark, d):
    i = interactions(spark, d)
    ids = persist_table(dictionary.id_map_first_seen(i, "user_id", "interaction_id"), "ids")
    coded = i.select("interaction_id", "user_id").join(ids, "user_id").select("interaction_id", "idx")
    return coded.join(ids, "idx").select("interaction_id", "user_id", "idx")


_DICT = f"""WITH {REVIEWS_SQL}, pieces AS (SELECT row_id, sentiment, list_filter(list_transform(regexp_split_to_array(review, '[:,?!\\n.]'), lambda x: trim(x, ' \t\r\n')), lambda x: x <> '') AS l FROM reviews),
    each AS (SELECT row_id, sentiment, unnest(l) AS statement, generate_subscripts(l, 1) - 1 AS pos FROM pieces),
    firsts AS (SELECT statement, sentiment, min(row_id * 100000 + pos) AS f, count(*) AS frequency FROM each GROUP BY statement, sentiment),
    dict AS (SELECT row_number() OVER (ORDER BY f) - 1 AS statement_id, statement, sentiment, frequency FROM firsts)"""


def statement_rows(spark, d) -> DataFrame:
    from explainkit.functions.text import sentences

    each = reviews(spark, d).select("row_id", "sentiment", sentences(F.col("review")).alias("l"))
    return each.select("row_id", F.transform("l", lambda s: F.struct(s.alias("statement"), F.col("sentiment").alias("sentiment"))).alias("statements"))


@query("dict_encode", f"{_DICT} SELECT statement_id, statement, sentiment, frequency FROM dict")
def _(spark, d):
    return dictionary.dict_encode(statement_rows(spark, d))[0]


@query("dict_encode_rows", f"{_DICT} SELECT row_id, string_agg(statement_id::VARCHAR, ',' ORDER BY pos) AS ids FROM each JOIN dict ON each.statement = dict.statement AND each.sentiment = dict.sentiment GROUP BY row_id")
def _(spark, d):
    return lists(dictionary.dict_encode(statement_rows(spark, d))[1], "row_id", "statement_ids")


def cluster_map(spark) -> DataFrame:
    """Statements 0..449 to fifty clusters; the rest is unmapped."""
    return spark.range(450).select(F.col("id").alias("statement_id"), (F.col("id") % 50).alias("cluster_id"))


_APPLY = f"""{DENSE}, e AS (SELECT interaction_id, unnest(statement_ids) AS sid, generate_subscripts(statement_ids, 1) AS pos FROM interactions),
    c AS (SELECT interaction_id, sid % 50 AS cluster_id, min(pos) AS pos FROM e WHERE sid < 450 GROUP BY 1, 2)"""


@query("apply_cluster_map", f"{_APPLY} SELECT interaction_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY pos) AS ids FROM c GROUP BY interaction_id")
def _(spark, d):
    return lists(dictionary.apply_cluster_map(interactions(spark, d), cluster_map(spark)), "interaction_id", "cluster_ids")


@query("cluster_freq", f"{_APPLY} SELECT r.range AS cluster_id, count(c.interaction_id) AS frequency FROM range(50) r LEFT JOIN c ON r.range = c.cluster_id GROUP BY r.range")
def _(spark, d):
    return dictionary.cluster_frequency(interactions(spark, d), cluster_map(spark))


@query("statements_vc", f"{_APPLY}, n AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) SELECT r.range AS statement_id, 'part ' || r.range AS statement, coalesce(n, 0) AS frequency FROM range(50) r LEFT JOIN n ON r.range = n.cluster_id")
def _(spark, d):
    counts = dictionary.cluster_frequency(interactions(spark, d), cluster_map(spark))
    return counts.select(F.col("cluster_id").alias("statement_id"), F.concat(F.lit("part "), F.col("cluster_id").cast("string")).alias("statement"), "frequency")


@query("set_intersect", f"{SPARSE}, {SPLITS_SQL} SELECT item_id FROM splits WHERE split = 'train' INTERSECT SELECT item_id FROM splits WHERE split = 'test'")
def _(spark, d):
    s = split_table(spark, d)
    return s.where("split = 'train'").select("item_id").intersect(s.where("split = 'test'").select("item_id"))


@query("set_except", f"{SPARSE}, {SPLITS_SQL} SELECT item_id FROM splits WHERE split = 'train' EXCEPT SELECT item_id FROM splits WHERE split = 'test'")
def _(spark, d):
    s = split_table(spark, d)
    return s.where("split = 'train'").select("item_id").subtract(s.where("split = 'test'").select("item_id"))


@query("axis_union", f"{DENSE} SELECT user_id AS owner, unnest(statement_ids) AS sid FROM interactions UNION SELECT item_id, unnest(statement_ids) FROM interactions")
def _(spark, d):
    i = interactions(spark, d)
    each = lambda k: i.select(F.col(k).alias("owner"), F.explode("statement_ids").alias("sid"))
    return each("user_id").union(each("item_id")).distinct()


@query(
    "stratified_sample",
    f"""WITH {VECTORS_SQL}, w AS (SELECT grp, greatest(1, round(60.0::DOUBLE * count(*) / (SELECT count(*) FROM vectors)))::BIGINT AS want FROM vectors GROUP BY grp),
    r AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY ('0x' || substr(md5(id::VARCHAR), 1, 13))::BIGINT, id) AS place FROM vectors) SELECT id, r.grp AS grp FROM r JOIN w ON r.grp = w.grp WHERE place <= want""",
)
def _(spark, d):
    from explainkit.operators.clusters import stratified_sample

    return stratified_sample(vectors(spark, d), "grp", "id", 60).select("id", "grp")


@query("stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def _(spark, d):
    from explainkit.streaming.ingest import running_counts

    return running_counts(read(spark, d, "events"))
