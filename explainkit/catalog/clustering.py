"""Neighbours, graphs, clusters and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.functions import vectors as vec
from explainkit.operators import clusters, graph, knn, lsh
from explainkit.plans.adapters import VECTORS_SQL, read, vectors
from explainkit.plans.storage import persist_table

QUERIES: dict = {}
K, TAU = 20, 0.35
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
KNN = f"""WITH RECURSIVE {VECTORS_SQL}, sims AS (SELECT a.grp, a.id AS src, b.id AS dst, round({COS}, 12) AS sim FROM vectors a JOIN vectors b ON a.grp = b.grp AND a.id <> b.id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims) WHERE rank <= {K})"""
EDGES = f"{KNN}, edges AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM near WHERE sim >= {TAU}), sym AS (SELECT a AS src, b AS dst FROM edges UNION SELECT b, a FROM edges)"
COMPONENTS = f"""{EDGES}, walk AS (SELECT id AS node, id AS low FROM vectors UNION SELECT s.dst, w.low FROM walk w JOIN sym s ON w.node = s.src WHERE w.low <= s.dst),
    comp AS (SELECT node AS id, min(low) AS component FROM walk GROUP BY node)"""
MEMBERS = f"WITH {VECTORS_SQL}, members AS (SELECT label AS cluster_id, id, v FROM vectors)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def neighbours(spark, d, k: int = K) -> DataFrame:
    return knn.knn_topk(vectors(spark, d), k)


def edges(spark, d) -> DataFrame:
    return knn.unique_pairs(neighbours(spark, d), TAU).select("grp", F.col("a").alias("src"), F.col("b").alias("dst"))


def members(spark, d) -> DataFrame:
    return vectors(spark, d).select(F.col("label").cast("bigint").alias("cluster_id"), "id", "embedding")


def components(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every vector's component, and the edges."""
    e = persist_table(edges(spark, d), "edges")
    found = graph.connected_components(e)
    v = vectors(spark, d)
    every = v.join(found, v["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"), "embedding")
    return every, e


@query("knn_topk", f"{KNN} SELECT src, rank, dst, round(sim, 6) AS sim FROM near WHERE rank <= 5")
def _(spark, d):
    return neighbours(spark, d, 5).select("src", F.col("rank").cast("bigint").alias("rank"), "dst", F.round("sim", 6).alias("sim"))


@query("unique_pairs", f"{KNN} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(sim), 6) AS sim, min(rank) AS rank FROM near WHERE sim >= {TAU} GROUP BY 1, 2")
def _(spark, d):
    return knn.unique_pairs(neighbours(spark, d), TAU).select("a", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("threshold_stats", f"{KNN} SELECT t.thr::DOUBLE AS thr, round(count(*) / (SELECT count(*) FROM vectors)::DOUBLE, 6) AS mean_neighbours, count(DISTINCT least(src, dst) * 1000000 + greatest(src, dst)) AS pairs FROM near, (VALUES (0.25), (0.3), (0.35)) t(thr) WHERE sim >= thr GROUP BY 1")
def _(spark, d):
    stats = knn.threshold_stats(neighbours(spark, d), vectors(spark, d).count(), [0.25, 0.3, 0.35])
    return stats.select("thr", F.round("mean_neighbours", 6).alias("mean_neighbours"), "pairs")


@query("edge_filter", f"{KNN} SELECT src, dst FROM near WHERE sim >= 0.3 AND rank <= 3")
def _(spark, d):
    return neighbours(spark, d).where("sim >= 0.3 AND rank <= 3").select("src", "dst")


@query("cosine_pairs", f"WITH {VECTORS_SQL} SELECT a.id AS a, b.id AS b, round({COS}, 6) AS sim FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def _(spark, d):
    v = vectors(spark, d).select("id", "embedding")
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("embedding").alias("y"))
    return v.join(other, "id").select(F.col("id").alias("a"), "b", F.round(vec.cosine(F.col("embedding"), F.col("y")), 6).alias("sim"))


@query("l2_normalize", f"WITH {VECTORS_SQL} SELECT id, round(list_sum(list_transform(v, lambda x: abs(x) / sqrt(list_dot_product(v, v)))), 6) AS l1 FROM vectors")
def _(spark, d):
    unit = vec.l2_normalize(F.col("embedding"))
    return vectors(spark, d).select("id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query("sym_edges", f"{EDGES} SELECT src, dst FROM sym")
def _(spark, d):
    return graph.symmetric_edges(edges(spark, d)).select("src", "dst")


@query("connected_components", f"{COMPONENTS} SELECT id, component FROM comp")
def _(spark, d):
    return components(spark, d)[0].select("id", "component")


@query("component_sizes", f"{COMPONENTS}, s AS (SELECT component, count(*) AS n FROM comp GROUP BY component) SELECT n, count(*) AS components FROM s GROUP BY n")
def _(spark, d):
    sizes = components(spark, d)[0].groupBy("component").agg(F.count("*").alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("components"))


@query("refine_components")
def _(spark, d):
    every, e = components(spark, d)
    return clusters.refine_components(every, e, intra=0.5, merge=0.9)


_SUMS = f"""{MEMBERS}, e AS (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM members), s AS (SELECT cluster_id, d, sum(x) AS x FROM e GROUP BY 1, 2),
    sums AS (SELECT cluster_id, list(x ORDER BY d) AS s FROM s GROUP BY 1), sizes AS (SELECT cluster_id, count(*) AS m FROM members GROUP BY 1)"""


@query(
    "cluster_representative",
    f"""{_SUMS}, sc AS (SELECT cluster_id, id, m, round(CASE WHEN m > 1 THEN (list_dot_product(v, s) - 1) / (m - 1) ELSE 1 END, 9) AS mean FROM members JOIN sums USING (cluster_id) JOIN sizes USING (cluster_id))
    SELECT cluster_id, id AS rep, m AS cluster_size, round(mean, 6) AS rep_mean_sim FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, id) AS rn FROM sc) WHERE rn = 1""",
)
def _(spark, d):
    return clusters.representatives(members(spark, d)).select("cluster_id", "rep", "cluster_size", F.round("rep_mean_sim", 6).alias("rep_mean_sim"))


@query("cluster_mean_sim", f"{_SUMS} SELECT cluster_id, m, round(CASE WHEN m > 1 THEN (list_dot_product(s, s) - m) / (m * (m - 1)) ELSE 1 END, 6) AS mean_sim FROM sums JOIN sizes USING (cluster_id)")
def _(spark, d):
    return clusters.mean_similarity(members(spark, d)).select("cluster_id", "m", F.round("mean_sim", 6).alias("mean_sim"))


@query("mean_pairwise_incl", f"{_SUMS} SELECT cluster_id, m, round(list_dot_product(s, s) / (m * m), 6) AS mean_sim FROM sums JOIN sizes USING (cluster_id)")
def _(spark, d):
    return clusters.mean_similarity(members(spark, d), diagonal=True).select("cluster_id", "m", F.round("mean_sim", 6).alias("mean_sim"))


_REPS = f"{_SUMS}, reps AS (SELECT cluster_id, m, arg_min(id, id) AS rep, arg_min(v, id) AS v FROM members JOIN sizes USING (cluster_id) GROUP BY cluster_id, m)"


def reps(spark, d) -> DataFrame:
    return members(spark, d).groupBy("cluster_id").agg(F.count("*").alias("m"), F.min("id").alias("rep"), F.min_by("embedding", "id").alias("embedding"))


@query("cluster_rep_text", f"{_REPS} SELECT cluster_id, rep, text FROM reps JOIN documents ON doc_id = rep")
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("rep"), "text")
    return reps(spark, d).select("cluster_id", "rep").join(docs, "rep").select("cluster_id", "rep", "text")


_PAIRS = "pairs AS (SELECT a.cluster_id, a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS sim FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.id < b.id)"


@query("cohesive", f"{MEMBERS}, {_PAIRS}, low AS (SELECT cluster_id, min(sim) AS low FROM pairs GROUP BY 1) SELECT DISTINCT m.cluster_id, coalesce(low >= 0.0, true) AS cohesive FROM members m LEFT JOIN low USING (cluster_id)")
def _(spark, d):
    return clusters.cohesion(members(spark, d), 0.0)


_SSE = f"{_SUMS}, {_PAIRS}, q AS (SELECT cluster_id, 2 * sum(greatest(0, 1 - sim) * greatest(0, 1 - sim)) AS dd FROM pairs GROUP BY 1), each AS (SELECT coalesce(dd, 0) / (2 * m) AS e FROM sizes LEFT JOIN q USING (cluster_id))"


@query("sse", f"{_SSE} SELECT round(sum(e), 5) AS total, round(avg(e), 6) AS mean FROM each")
def _(spark, d):
    return clusters.sse(members(spark, d)).select(F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean"))


def _ssb(name: str, weighted: bool) -> None:
    weight = "b.m / (SELECT count(*) FROM members)::DOUBLE" if weighted else "1.0"
    d2 = "greatest(0, 1 - list_dot_product(a.v, b.v)) * greatest(0, 1 - list_dot_product(a.v, b.v))"

    @query(name, f"{_REPS} SELECT round(sum({d2} * {weight}) / (2.0 * (SELECT count(*) FROM reps)), 6) AS ssb FROM reps a, reps b")
    def _(spark, d):
        return clusters.ssb(reps(spark, d), members(spark, d).count(), weighted).select(F.round("ssb", 6).alias("ssb"))


_ssb("ssb", True)
_ssb("ssb_plain", False)

_DIAMETER = f"{MEMBERS}, {_PAIRS}, far AS (SELECT cluster_id, max(greatest(0, 1 - sim)) AS d FROM pairs GROUP BY 1), wide AS (SELECT DISTINCT m.cluster_id, coalesce(d, 0) AS diameter FROM members m LEFT JOIN far USING (cluster_id))"
_INTER = "inter AS (SELECT min(greatest(0, 1 - list_dot_product(a.v, b.v))) AS d FROM members a JOIN members b ON a.cluster_id < b.cluster_id)"


@query("cluster_diameter", f"{_DIAMETER} SELECT cluster_id, round(diameter, 6) AS diameter FROM wide")
def _(spark, d):
    return clusters.diameters(members(spark, d)).select("cluster_id", F.round("diameter", 6).alias("diameter"))


@query("intercluster_min", f"{MEMBERS}, {_INTER} SELECT round(d, 6) AS min_distance FROM inter")
def _(spark, d):
    return clusters.intercluster_min(members(spark, d)).select(F.round("min_distance", 6).alias("min_distance"))


@query("dunn", f"{_DIAMETER}, {_INTER} SELECT round((SELECT d FROM inter) / max(diameter), 6) AS dunn FROM wide")
def _(spark, d):
    return clusters.dunn_index(members(spark, d)).select(F.round("dunn", 6).alias("dunn"))


@query("cluster_reduction", f"{COMPONENTS} SELECT count(*) AS points, count(DISTINCT component) AS clusters, round((count(*) - count(DISTINCT component)) * 100.0::DOUBLE / count(*), 6) AS reduction FROM comp")
def _(spark, d):
    every = components(spark, d)[0]
    n, k = F.count("*"), F.countDistinct("component")
    return every.agg(n.alias("points"), k.alias("clusters"), F.round((n - k) * 100.0 / n, 6).alias("reduction"))


@query("stmt_to_cluster", f"{COMPONENTS} SELECT component AS cluster_id, id AS statement_id FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)")
def _(spark, d):
    every = components(spark, d)[0].select(F.col("component").alias("cluster_id"), F.col("id").alias("statement_id"))
    large = every.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    return every.join(large, "cluster_id", "left_semi")


@query(
    "near_far_k",
    f"""{_REPS}, m AS (SELECT x.cluster_id, x.id, round(list_dot_product(x.v, r.v), 9) AS sim FROM members x JOIN reps r ON x.cluster_id = r.cluster_id AND x.id <> r.rep),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, id) AS near, row_number() OVER (PARTITION BY cluster_id ORDER BY sim, id) AS far FROM m)
    SELECT cluster_id, id, near, far FROM r WHERE near <= 3 OR far <= 2""",
)
def _(spark, d):
    r = reps(spark, d).select("cluster_id", "rep", F.col("embedding").alias("y"))
    m = members(spark, d).join(r, "cluster_id").where("id <> rep").select("cluster_id", "id", F.round(vec.dot(F.col("embedding"), F.col("y")), 9).alias("sim"))
    found = knn.nearest_and_farthest(m, "cluster_id", 3, 2)
    return found.select("cluster_id", "id", F.col("near").cast("bigint").alias("near"), F.col("far").cast("bigint").alias("far"))


@query("weighted_sample", f"{_REPS}, k AS (SELECT cluster_id, m, -ln((('0x' || substr(md5(cluster_id || ',0'), 1, 13))::BIGINT + 1) / (pow(2, 52) + 2)) / m AS key FROM reps WHERE m >= 3) SELECT cluster_id, m AS cluster_size FROM k ORDER BY key, cluster_id LIMIT 5")
def _(spark, d):
    return clusters.sample_clusters(reps(spark, d).select("cluster_id", F.col("m").alias("cluster_size")), 5, 3)


def texts(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


_SHINGLES = "WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\\s]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w WHERE len(w) >= 2)"


@query(
    "jaccard_pairs",
    f"""{_SHINGLES}, e AS (SELECT id, unnest(s) AS x FROM s), c AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
    SELECT c.a, c.b, round(n / (len(x.s) + len(y.s) - n)::DOUBLE, 6) AS jaccard FROM c JOIN s x ON c.a = x.id JOIN s y ON c.b = y.id WHERE n / (len(x.s) + len(y.s) - n)::DOUBLE >= 0.9""",
)
def _(spark, d):
    return lsh.jaccard_pairs(texts(spark, d), 0.9).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def utterances(spark, d) -> DataFrame:
    turns = read(spark, d, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")


@query(
    "minhash_groups",
    """WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[\\s]+'), lambda x: x <> '') AS w FROM t),
    s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM w WHERE len(w) >= 2), h AS (SELECT s, min(id) AS id FROM s GROUP BY s), e AS (SELECT id, unnest(s) AS x FROM h),
    c AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
    near AS (SELECT a, b FROM c JOIN h x ON c.a = x.id JOIN h y ON c.b = y.id WHERE n / (len(x.s) + len(y.s) - n)::DOUBLE >= 0.9), sym AS (SELECT a AS src, b AS dst FROM near UNION SELECT b, a FROM near),
    walk AS (SELECT id AS node, id AS low FROM h UNION SELECT y.dst, k.low FROM walk k JOIN sym y ON k.node = y.src WHERE k.low <= y.dst), g AS (SELECT node, min(low) AS low FROM walk GROUP BY node)
    SELECT coalesce(g.low, t.id) AS group_id, t.id AS id FROM t LEFT JOIN s ON t.id = s.id LEFT JOIN h ON s.s = h.s LEFT JOIN g ON h.id = g.node""",
)
def _(spark, d):
    return lsh.minhash_groups(utterances(spark, d), 0.9)


@query("greedy_groups")
def _(spark, d):
    return lsh.greedy_groups(utterances(spark, d), 0.9, "role")
