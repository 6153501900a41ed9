"""Worked examples of the operators."""

import math

import pytest
from explainkit.functions import json_text, text
from explainkit.functions.hashing import stable_hash64
from explainkit.operators import clusters, dictionary, factors, graph, knn, paired_stats, popularity, ranking, splits
from explainkit.sources import atomic, reviews
from pyspark.sql import functions as F


def test_leave_last_two(spark):
    rows = [(0, "A", "x", 3), (1, "A", "y", 1), (2, "A", "x", 2), (3, "A", "z", 4), (4, "B", "x", 1), (5, "B", "y", 2), (6, "C", "y", 5), (7, "C", "w", 5), (8, "C", "x", 5), (9, None, "x", 1)]
    df = spark.createDataFrame(rows, "interaction_id long, user_id string, item_id string, ts long")
    got = {r["interaction_id"]: r["split"] for r in splits.leave_last_two(df).collect()}
    assert got == {1: "train", 2: "train", 6: "train", 0: "eval", 8: "test"}


def test_dictionary(spark):
    rows = [(0, [("s1", "positive"), ("s2", "Negative "), ("s1", "positive")]), (1, [("s2", "positive"), ("s1", "positive")]), (2, [("s3", "weird")]), (3, None)]
    df = spark.createDataFrame(rows, "row_id long, statements array<struct<statement:string,sentiment:string>>")
    words, ids = dictionary.dict_encode(df)
    assert sorted(map(tuple, words.collect())) == [(0, "s1", "positive", 3), (1, "s2", "negative", 1), (2, "s2", "positive", 1)]
    assert {r["row_id"]: r["statement_ids"] for r in ids.collect()} == {0: [0, 1, 0], 1: [2, 0]}


def test_cluster_map(spark):
    df = spark.createDataFrame([(0, [5, 6, 5, 9]), (1, [7])], "interaction_id long, statement_ids array<long>")
    mapping = spark.createDataFrame([(5, 0), (6, 0), (9, 3), (11, 4)], "statement_id long, cluster_id long")
    assert [(r[0], r[1]) for r in dictionary.apply_cluster_map(df, mapping).collect()] == [(0, [0, 3])]
    assert dict(dictionary.cluster_frequency(df, mapping).collect()) == {0: 1, 3: 1, 4: 0}


def test_popularity(spark):
    df = spark.createDataFrame([("a", "x", [0, 1, 1]), ("a", "y", [1, 7]), ("b", "x", [1])], "user_id string, item_id string, statement_ids array<long>")
    assert dict(popularity.popularity_counts(df, 4).collect()) == {0: 1, 1: 3}
    assert {tuple(r) for r in popularity.popularity_counts(df, 4, "item_id").collect()} == {("x", 0, 1), ("x", 1, 2), ("y", 1, 1)}


def test_hash(spark):
    got = [r[0] % 2**64 for r in spark.range(4).select(stable_hash64(F.col("id"))).collect()]
    assert got == [0, 6238072747940578789, 15839785061582574730, 2185194620014831856]
    ranks = popularity.random_ranks(spark.range(4).select(F.col("id").alias("sid"))).orderBy("rank").collect()
    assert [r["sid"] for r in ranks] == [0, 3, 1, 2]


def test_ranking_metrics(spark):
    scored = spark.createDataFrame([(1, 10, 5.0, False), (1, 11, 5.0, True), (1, 12, 3.0, False), (1, 13, 0.0, True), (2, 10, 1.0, False)], "id long, sid long, score double, is_pos boolean")
    ranked = popularity.rank_within(scored, ["id"]).where("is_pos")
    rows = ranking.ranking_metrics(ranked, ["id"], (1, 3, 10)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert [r["hit1"], r["p1"], r["ndcg1"]] == [0, 0, 0]
    assert [r["p3"], r["r3"], r["ndcg3"]] == pytest.approx([1 / 3, 0.5, 0.386853], abs=1e-6)
    assert [r["p10"], r["r10"], r["ndcg10"]] == pytest.approx([0.2, 1.0, 0.650921], abs=1e-6)
    none = ranking.macro_average(ranking.ranking_metrics(ranked.limit(0), ["id"], (3,)), ["ndcg3"]).first()
    assert tuple(none) == (0, 0.0)


def test_legacy_metrics(spark):
    predicted = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "k long, v long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 13)], "k long, v long")
    assert tuple(ranking.legacy_list_metrics(predicted, truth, "k", "v", 3).first()) == pytest.approx((0.296082, 0.333333, 0.5, 0.4), abs=1e-6)


def vectors(spark, angles):
    rows = [(i, 0, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(angles)]
    return spark.createDataFrame(rows, "id long, grp int, embedding array<double>")


@pytest.mark.parametrize("block", [1, 2, 100])
def test_knn(spark, block):
    v = vectors(spark, [0, 10, 20, 50, 60])
    near = knn.knn_topk(v, 2, block=block)
    got = {(r["src"], r["rank"]): r["dst"] for r in near.collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0, (3, 1): 4, (3, 2): 2, (4, 1): 3, (4, 2): 2}
    pairs = {(r["a"], r["b"]): (round(r["sim"], 6), r["rank"]) for r in knn.unique_pairs(near, 0.9).collect()}
    assert pairs == {(0, 1): (0.984808, 1), (0, 2): (0.939693, 2), (1, 2): (0.984808, 1), (3, 4): (0.984808, 1)}
    stats = knn.threshold_stats(near, 5, [0.9]).first()
    assert (stats["mean_neighbours"], stats["pairs"]) == (1.6, 4)


def test_components(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (7, 7), (None, 3)], "src long, dst long")
    assert dict(graph.connected_components(edges).collect()) == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4}
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert {r["component"] for r in graph.connected_components(path).collect()} == {0}
    star = spark.createDataFrame([(500, i) for i in range(400)], "src long, dst long")
    assert graph.connected_components(star).where("component = 0").count() == 401
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_refinement():
    unit = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    edges = [(0, 1), (0, 2), (2, 3), (3, 4)]
    assert clusters.refine_one({i: unit(a) for i, a in enumerate([0, 10, 20, 50, 60])}, edges, 0.9) == [[0, 1, 2], [3, 4]]
    assert clusters.refine_one({i: unit(a) for i, a in enumerate([0, 10, 20, 20, 60])}, edges, 0.9) == [[0, 1, 2, 3, 4]]


def test_representatives(spark):
    v = vectors(spark, [0, 10, 20]).withColumn("cluster_id", F.lit(1)).unionByName(vectors(spark, [5]).withColumn("cluster_id", F.lit(2)))
    got = {r["cluster_id"]: r for r in clusters.representatives(v).collect()}
    assert (got[1]["rep"], got[1]["rep_mean_sim"], got[1]["cluster_mean_sim"]) == pytest.approx((1, 0.984808, 0.969770), abs=2e-6)
    assert (got[2]["rep"], got[2]["rep_mean_sim"], got[2]["cluster_mean_sim"]) == (0, 1.0, 1.0)


def test_sse_ssb(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [0.0, 1.0])]
    m = spark.createDataFrame(rows, "id long, cluster_id long, embedding array<double>")
    assert tuple(clusters.sse(m).first()) == (0.5, 0.25)
    reps = spark.createDataFrame([(0, 2, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "cluster_id long, m long, embedding array<double>")
    assert clusters.ssb(reps, 3).first()[0] == pytest.approx(0.25)
    assert clusters.ssb(reps, 3, weighted=False).first()[0] == pytest.approx(0.5)


def test_paired(spark):
    pairs = spark.createDataFrame([(float(x), 0.0, float(x)) for x in (1, 0, -1, 2, 1)], "a double, b double, diff double")
    s = paired_stats.paired_stats(pairs).first()
    assert (s["n"], s["mean_diff"], s["median_diff"], s["cliffs_delta"]) == (5, 0.6, 1.0, 0.4)
    assert (s["cohen_d"], s["t"]) == pytest.approx((0.526235, 1.176697), abs=1e-6)
    assert paired_stats.wilcoxon(pairs).first()["w"] == 2
    assert math.isnan(paired_stats.paired_stats(pairs.limit(3)).first()["cohen_d"])
    assert paired_stats.student_p(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    p = spark.createDataFrame([(0.03,), (0.0005,), (0.2,), (float("nan"),)], "p double")
    assert [r[0] for r in p.select(paired_stats.significance_label(F.col("p"))).collect()] == ["p<0.05", "p<0.001", "ns", "na"]


NORMAL = {
    "It's great for kids!": "the product 's great for kids", "This product works well": "the product product works well", "The item costs $3.50, overall": "the product costs $3 50",
    "Two-in-one design": "2 in 1 design", "it works": "the product works", "See http://x.com/a now please": "see url now please", "AT&amp;T phone case fits": "at&t phone case fits",
    "the product": None, "Great!": None, "  ": None, None: None,
}


def test_normaliser(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL], "s string")
    assert {r[0]: r[1] for r in df.select("s", text.normalize_statement(F.col("s"))).collect()} == NORMAL
    one = spark.createDataFrame([("it has 3 of 12 parts and 2,5 more",)], "s string")
    assert one.select(text.number_bucket(F.col("s"))).first()[0] == "it has <n3_5> of <n10p> parts and <n3_5> more"
    assert one.select(text.normalize_statement(F.col("s"), numbers="mask")).first()[0] == "the product has num of num parts and num num more".replace("num", "<num>")


def test_json(spark):
    cases = {'x [ {"a":1} ] y': '[ {"a":1} ]', "no json": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] and r[1].replace("[ {", "[ {") for r in df.select("s", json_text.first_array(F.col("s"))).collect()} == cases
    bad = spark.createDataFrame([('{"other":1}',), ('say {"statements": [ {"statement":"a"} ]} ok',)], "s string")
    assert [r[0] for r in bad.select(json_text.first_statements(F.col("s"))).collect()] == [None, '{"statements": [ {"statement":"a"} ]}']
    v = spark.createDataFrame([('{"atomicity":"1","explainatoriness":0}',), ('{"atomicity":2,"explainatoriness":0}',), ('{"atomicity":1,"explainatoriness":0,"x":1}',), ("no",)], "s string")
    assert [r[0] and tuple(r[0]) for r in v.select(json_text.verdict(F.col("s"))).collect()] == [(1, 0), None, None, None]
    lists = spark.createDataFrame([("[1, 2]",), ("nan",), ("",), (None,), ("[]",)], "s string")
    assert [r[0] for r in lists.select(json_text.parse_int_list(F.col("s"))).collect()] == [[1, 2], None, None, None, []]


def test_shingles_and_sentences(spark):
    df = spark.createDataFrame([("A b c a b",), ("one",)], "s string")
    assert [sorted(r[0]) for r in df.select(text.k_shingles(F.col("s"), 2)).collect()] == [["a b", "b c", "c a"], []]
    assert sorted(df.select(text.k_shingles(F.col("s"), 1)).first()[0]) == ["a", "b", "c"]
    s = spark.createDataFrame([("Good, solid: nice!\nbad?ok.",)], "s string")
    assert s.select(text.sentences(F.col("s"))).first()[0] == ["Good", "solid", "nice", "bad", "ok"]


def test_adjacency(spark):
    edges = spark.createDataFrame([("u0", "t0", 1), ("u0", "t1", 2)], "r string, c string, w long")
    got = {r["c"]: round(r["w"], 6) for r in factors.normalized_adjacency(edges).collect()}
    assert got == {"t0": 0.57735, "t1": 0.816497}


def test_offsets(spark):
    row = spark.createDataFrame([(1, 6, 1, 2, 3, 4, 5)], "interaction_id long, k int, pos_end int, common_end int, user_end int, item_end int, all_end int")
    got = ranking.offset_masks(row).orderBy("pos").collect()
    assert [r["kind"] for r in got] == ["pos", "common", "user", "item", "neg", "none"]
    assert [r["pos"] for r in got if r["axis_user"]] == [0, 1, 2] and [r["pos"] for r in got if r["axis_item"]] == [0, 1, 3]


def test_shards(spark):
    assert [r[0] for r in reviews.shard(spark.range(5), "id", 2, 1).collect()] == [1, 3]
    got = {r["id"]: r["shard"] for r in reviews.shard_ranges(spark.range(10), "id", 2, 2, 10).collect()}
    assert [k for k, v in sorted(got.items()) if v == 0] == [0, 1, 2, 3, 4, 5]


def test_guards(spark):
    with pytest.raises(ValueError):
        reviews.require_columns(spark.range(1), ["statement"])
    with pytest.raises(ValueError):
        reviews.require_vectors(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))
    with pytest.raises(ValueError):
        from explainkit.operators.evaluate import positive_ranks

        df = spark.createDataFrame([(1, 1, 1, [1], "test")], "interaction_id long, user_id long, item_id long, statement_ids array<long>, split string")
        positive_ranks(popularity.RandomRanker(), "odd", df, df, spark.range(3).withColumnRenamed("id", "sid"), 3)


def test_negatives(spark):
    pos = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, 0), (3, 1), (3, 2)], "u long, s long")
    got = factors.negative_samples(pos, "u", "s", 4).collect()
    assert len(got) == 6
    have = {1: {0, 1}, 2: {2}, 3: {0, 1, 2}}
    assert all(r["negative"] not in have[r["u"]] and 0 <= r["negative"] < 4 for r in got)


def test_atomic_files(spark, tmp_path):
    df = spark.createDataFrame([("u", "i", 4.0, [1, 2], "train")], "user_id string, item_id string, rating double, statement_ids array<long>, split string")
    atomic.write_atomic(df, f"file://{tmp_path}/a")
    back = spark.read.options(sep="\t", header="true").csv(f"file://{tmp_path}/a/train")
    assert tuple(back.first()) == ("u", "i", "4.0", "1,2")


def test_streaming_extraction(spark, tmp_path):
    from explainkit.functions.models import SentenceExtractor
    from explainkit.streaming.ingest import extract_stream, running_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"overall": 5.0, "reviewText": "It is a good toy. Kids love this thing.", "summary": "Nice", "reviewerID": "u", "asin": "i"}\n')
    for _ in range(2):  # the checkpoint makes the second run a no-op
        extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), SentenceExtractor()).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and [s["sentiment"] for s in rows[0]["statements"]] == ["positive", "positive"]
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    q = running_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("cnt")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_json_source(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"overall": 5.0, "unixReviewTime": 7, "asin": "i"}\n')
    row = reviews.read_reviews(spark, str(tmp_path / "r.json")).first()
    assert (row["rating"], row["timestamp"], row["item_id"], row["review"]) == (5.0, 7, "i", None)
    (tmp_path / "c.csv").write_text('sentiment,representative_index,cluster_size,member_indices\npositive,1,2,"[1, 2]"\n')
    assert reviews.read_table(spark, str(tmp_path / "c.csv"), "clusters").first()["member_indices"] == [1, 2]
    (tmp_path / "m.json").write_text('{"3": 1, "4": 1}')
    assert dict(reviews.read_map(spark, str(tmp_path / "m.json")).collect()) == {3: 1, 4: 1}
