"""Trained models, files, samples and measures beyond the SQL of the catalogue."""

import math
import random

import numpy as np
import pytest
from explainkit.functions import text
from explainkit.operators import clusters, dictionary, factors, graph_model, knn, paired_stats, popularity, samples, text_gate
from explainkit.plans import storage
from explainkit.sources import artifacts
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def liked(spark):
    """Even users have even items and statements, odd ones odd."""
    rng = random.Random(3)
    rows = [(n, n % 24, rng.randrange(5) * 2 + n % 2, [rng.randrange(6) * 2 + n % 2 for _ in range(rng.randint(1, 3))]) for n in range(240)]
    return spark.createDataFrame(rows, "interaction_id long, user_id long, item_id long, statement_ids array<long>")


def test_joint_loss_falls_and_sides_are_learned(liked):
    trainer = graph_model.JointGraph(liked, dim=6, item_layers=1, tag_layers=1, rate=0.3)
    model = trainer.fit(6)
    assert trainer.losses[-1] < 0.8 * trainer.losses[0]
    top = graph_model.recommend_items(model, 3).collect()
    assert sum(r["thing"] % 2 == r["id"] % 2 for r in top) > 0.9 * len(top) == 0.9 * 72
    pairs = liked.select(F.col("interaction_id").alias("pair"), "user_id", "item_id").limit(20)
    tags = graph_model.recommend_tags(model, pairs, 2).collect()
    assert len(tags) == 40 and sum(r["thing"] % 2 == r["pair"] % 2 for r in tags) > 30


def test_joint_gradient(liked):
    """The step's direction against finite differences of the loss, at one user's vector."""
    trainer = graph_model.JointGraph(liked, dim=3, item_layers=1, tag_layers=1, rate=1e-4)
    start = trainer.initial()
    after = trainer.step(start, 0)
    base = trainer.losses[-1]
    trainer.step(after, 0)
    assert trainer.losses[-1] < base
    vectors = {r["id"]: r["v"] for r in start.start["user"].collect()}
    moved = {r["id"]: r["v"] for r in after.start["user"].collect()}
    slope = []
    for k in range(3):
        nudged = [(i, [x + (1e-4 if i == 5 and j == k else 0) for j, x in enumerate(v)]) for i, v in vectors.items()]
        table = liked.sparkSession.createDataFrame(nudged, "id long, v array<double>")
        trainer.step(graph_model.Model({**start.start, "user": table}), 0)
        slope.append((trainer.losses[-1] - base) / 1e-4)
    step = np.array(moved[5]) - np.array(vectors[5])
    assert np.dot(step, slope) / (np.linalg.norm(step) * np.linalg.norm(slope)) == pytest.approx(-1, abs=0.02)


def test_early_stopping_keeps_the_best(liked):
    trainer = graph_model.JointGraph(liked, dim=2, item_layers=1, tag_layers=1)
    values = iter([0.3, 0.5, 0.4, 0.2, 0.9])
    trainer.fit(5, quality=lambda m: next(values), patience=2)
    assert len(trainer.losses) == 4
    assert graph_model.joint_quality(0.25, 0.16) == pytest.approx(0.2)
    assert graph_model.search({"a": [1, 2], "b": [3]}, lambda a, b: -a * b)[:2] == ({"a": 1, "b": 3}, -3)


def test_model_state_round_trip(liked, spark, tmp_path):
    trainer = graph_model.JointGraph(liked, dim=2)
    model = trainer.initial()
    graph_model.save_model(model, f"file://{tmp_path}/state")
    back = graph_model.load_model(spark, f"file://{tmp_path}/state")
    for side in graph_model.SIDES:
        assert sorted(map(tuple, ((r["id"], tuple(r["v"])) for r in back.start[side].collect()))) == sorted(map(tuple, ((r["id"], tuple(r["v"])) for r in model.start[side].collect())))


def test_gated_factors_follow_texts(spark, liked):
    hidden = spark.createDataFrame([(s, [float(s % 2), float(1 - s % 2)]) for s in range(12)], "sid long, hidden array<double>")
    model = text_gate.gated_factors(liked, hidden, 12, dim=6, rate=0.3, epochs=12, batch=16, block=60).persist()
    pairs = liked.select(F.col("interaction_id").alias("pair"), "user_id", "item_id").limit(40)
    best = text_gate.best_gated(model, pairs, 3).collect()
    assert len(best) == 120 and sum(r["thing"] % 2 == r["pair"] % 2 for r in best) > 100


def test_two_stages(spark, liked):
    users, statements, items = factors.user_factors(liked, 12, dim=6, rate=0.3, epochs=6, alpha=1.0, block=60)
    test = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 99)], "user_id long, item_id long")
    found = factors.two_stage(users, items, statements, test, 5, 2).collect()
    assert {(r["user_id"], r["item_id"]) for r in found} <= {(0, 0), (0, 1), (1, 1)} and len(found) % 2 == 0 and found


def test_best_places_with_ties():
    rng = np.random.default_rng(2)
    for scores in (rng.integers(0, 4, (40, 9)).astype(float), rng.random((40, 9)), np.zeros((3, 9)), np.empty((0, 9))):
        for k in (1, 3, 9, 12):
            assert graph_model.best_places(scores, k).tolist() == np.argsort(-scores, axis=1, kind="stable")[:, :k].tolist()


def test_search_shares_its_graph(spark, monkeypatch):
    """All step lengths train over one graph; a trainer's losses are its own."""
    built = []
    monkeypatch.setattr(graph_model.JointGraph, "__post_init__", (lambda f: lambda self: (built.append(1), f(self))[1])(graph_model.JointGraph.__post_init__))
    from explainkit import catalog

    found = {r["rate"]: (r["quality"], r["best"]) for r in catalog.queries()["joint_search"](spark, "/root/testdata/sf0.001").collect()}
    assert len(built) == 1 and set(found) == {0.02, 0.1} and sum(b for _, b in found.values()) == 1


def test_top_of_blocks_is_exact(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 4)).round(2), rng.normal(size=(50, 4)).round(2)
    table = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["thing"] for r in graph_model.top_of_blocks(table(a), table(b), 4, block=7).collect()}
    scores = np.round(a @ b.T, 9)
    want = {(i, r + 1): j for i in range(30) for r, j in enumerate(sorted(range(50), key=lambda j: (-scores[i, j], j))[:4])}
    assert got == want


@pytest.mark.parametrize("block", [3, 2048])
def test_neighbours_of_blocks(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)).round(1)
    x[7] = x[9] = x[11]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, grp int, embedding array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 12)
    want = {(i, r + 1, j) for i in range(40) for r, j in enumerate(sorted((j for j in range(40) if j != i and j % 2 == i % 2), key=lambda j: (-sims[i, j], j))[:3])}
    assert {(r["src"], r["rank"], r["dst"]) for r in knn.knn_topk(df, 3, block=block).collect()} == want


def test_cluster_measures_without_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 4 if i < 57 else 10 + i, v.tolist()) for i, v in enumerate(x)], "id long, cluster_id int, embedding array<double>").repartition(3)
    groups = [[i for i in range(57) if i % 4 == c] for c in range(4)] + [[57], [58], [59]]
    each = [sum((1 - x[i] @ x[j]) ** 2 for i in g for j in g) / (2 * len(g)) for g in groups]
    row = clusters.sse(df).first()
    assert (row["total"], row["mean"]) == (pytest.approx(sum(each)), pytest.approx(sum(each) / 7))
    wide = {r["cluster_id"]: r["diameter"] for r in clusters.diameters(df).collect()}
    low = {r["cluster_id"]: r["low"] for r in clusters.lowest_similarity(df, block=4).collect()}
    for c in range(4):
        least = min(x[i] @ x[j] for i in groups[c] for j in groups[c] if i != j)
        assert wide[c] == pytest.approx(1 - least) and low[c] == pytest.approx(least)
    assert wide[67] == 0 and 67 not in low
    reps = spark.createDataFrame([(c, len(g), x[g[0]].tolist()) for c, g in enumerate(groups)], "cluster_id int, m long, embedding array<double>")
    want = sum((1 - x[a[0]] @ x[b[0]]) ** 2 * len(b) / 60 for a in groups for b in groups) / 14
    assert clusters.ssb(reps, 60).first()["ssb"] == pytest.approx(want)


def test_refinement_by_brute_force(spark):
    """Components split by a plain search for the node with most neighbours left; coherent ones stay whole."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(48, 3))
    x[:6] = [1, 0, 0] + rng.normal(size=(6, 3)) * 0.05
    comp = [0] * 6 + [10] * 30 + [40] * 12
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 48, (160, 2)) if a != b and comp[a] == comp[b]})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: 0 for i in range(6)}
    for name in (10, 40):
        left, open_group, pivots, groups = {i for i in range(48) if comp[i] == name}, set(), [], []
        near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in left}
        while left:
            pivot = min(left, key=lambda n: (-len(near[n] & left), n))
            if open_group and min(unit[p] @ unit[pivot] for p in pivots) < 0.6:
                groups.append(open_group)
                open_group, pivots = set(), []
            taken = {pivot} | near[pivot] & left
            open_group |= taken
            pivots.append(pivot)
            left -= taken
        for g in [*groups, open_group]:
            want |= dict.fromkeys(g, min(g))
    members = spark.createDataFrame([(comp[i], i, v.tolist()) for i, v in enumerate(x)], "component long, id long, embedding array<double>")
    found = clusters.refine_components(members, spark.createDataFrame(edges, "src long, dst long"), intra=0.8, merge=0.6).collect()
    assert {r["id"]: r["cluster_id"] for r in found} == want and len(found) == 48 and len(set(want.values())) > 4


def test_running_totals_and_median(spark):
    rng = random.Random(8)
    values = [rng.randrange(30) for _ in range(201)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    got = {r["i"]: r["upto"] for r in dictionary.running_totals(df, ["i"], upto="v").collect()}
    assert got == {i: sum(values[: i + 1]) for i in range(201)}
    for n in (0, 1, 2, 7, 200, 201):
        found = paired_stats.exact_median(df.where(F.col("i") < n), "v").first()[0]
        assert found == (None if not n else float(np.median(values[:n])))


def test_universe_ranks_by_brute_force(spark):
    rng = random.Random(6)
    counts = [(u, s, rng.randint(1, 4)) for u in range(6) for s in rng.sample(range(20), 7)]
    df = spark.createDataFrame(counts, "user_id long, sid long, cnt long")
    wanted = spark.createDataFrame([(n, u, s) for n, (u, s) in enumerate((u, s) for u in range(8) for s in range(20))], "at long, user_id long, sid long")
    statements = spark.range(20).select(F.col("id").alias("sid"))
    held = {(u, s): c for u, s, c in counts}
    for r in popularity.universe_ranks(wanted, df, "user_id", statements).collect():
        order = sorted(range(20), key=lambda s: (-held.get((r["user_id"], s), 0), s))
        assert r["rank"] == order.index(r["sid"]) + 1
    whole = df.groupBy("sid").agg(F.sum("cnt").alias("cnt"))
    total = dict(whole.collect())
    for r in popularity.universe_ranks(wanted, whole, None, statements).collect():
        assert r["rank"] == sorted(range(20), key=lambda s: (-total.get(s, 0), s)).index(r["sid"]) + 1


def test_wilcoxon_of_nothing(spark):
    pairs = spark.createDataFrame([(1.0, 1.0, 0.0)], "a double, b double, diff double")
    assert paired_stats.wilcoxon(pairs).first()["p"] == 1.0


def test_t_distribution_by_integration():
    for t, df in ((0.5, 3), (2.1, 10), (-1.3, 40)):
        density = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        steps = np.linspace(0, abs(t), 20_001)
        inner = np.trapezoid([density(x) for x in steps], steps)
        assert paired_stats.student_p(t, df) == pytest.approx(1 - 2 * inner, abs=1e-6)


def test_numbers_that_cannot_be_read(spark):
    df = spark.createDataFrame([("size ٣ of 4,5 and 12",), ("Two or twenty onetwo",)], "t string")
    assert [r[0] for r in df.select(text.number_bucket(F.col("t"))).collect()] == ["size <num> of <n3_5> and <n10p>", "Two or twenty onetwo"]
    assert [r[0] for r in df.select(text.number_words(F.col("t"))).collect()] == ["size ٣ of 4,5 and 12", "2 or 20 onetwo"]


def test_array_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(9)], "row long, values array<double>").repartition(3)
    artifacts.write_npy(rows, f"{base}/x.npy", 9, 2, block=4)
    assert np.load(f"{tmp_path}/x.npy").tolist() == [[i, i / 2] for i in range(9)]
    assert sorted(map(tuple, ((r["row"], tuple(r["values"])) for r in artifacts.read_npy(spark, f"{base}/x.npy", 2).collect()))) == [(i, (i, i / 2)) for i in range(9)]
    with pytest.raises(ValueError):
        artifacts.read_npy(spark, f"{base}/x.npy", 3)
    with pytest.raises(ValueError):
        artifacts.join_rows(spark.range(8), artifacts.read_npy(spark, f"{base}/x.npy"), "id")
    pools = spark.createDataFrame([(0, [5, 6], [1, 2, 2, 2, 2], None), (1, [7], [1, 1, 1, 1, 1], [1, 1, 1, 1])], "interaction_id long, pool array<long>, offsets array<int>, negatives array<int>")
    artifacts.write_artifacts(pools, f"{base}/a", 2, 3)
    found = artifacts.read_artifacts(spark, f"{base}/a", 2, 3)
    assert [(r["pool"], r["offsets"], r["negatives"]) for r in found.orderBy("interaction_id").collect()] == [([5, 6, -1], [1, 2, 2, 2, 2], [0] * 4), ([7, -1, -1], [1] * 5, [1] * 4)]
    assert sorted(map(tuple, artifacts.pool_rows(found).collect())) == [(0, 0, 5), (0, 1, 6), (1, 0, 7)]
    for n, width in ((3, 3), (2, 4)):
        with pytest.raises(ValueError):
            artifacts.read_artifacts(spark, f"{base}/a", n, width)
    with pytest.raises(FileNotFoundError):
        artifacts.read_artifacts(spark, f"{base}/none", 2, 3)


def test_artifacts_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Blocks end where they must, bad rows are refused, and no row passes through the driver."""
    from pyspark.sql import DataFrame

    def never(self, *args, **kwargs):
        raise AssertionError("rows pass through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    base = f"file://{tmp_path}"
    shape = "interaction_id long, pool array<long>, offsets array<int>, negatives array<int>"
    rows = [(i, list(range(i % 4)), [i] * 5, [i] * 4 if i % 3 else None) for i in range(50)]
    table = lambda r: spark.createDataFrame(r, shape).repartition(3)
    artifacts.write_artifacts(table(rows), f"{base}/a", 50, 3, block=7)
    pool = np.fromfile(f"{tmp_path}/a/{artifacts.POOL_FILE}", "<i4").reshape(50, 3).tolist()
    assert pool == [p + [-1] * (3 - len(p)) for _, p, _, _ in rows]
    assert np.load(f"{tmp_path}/a/{artifacts.OFFSETS_FILE}").tolist() == [o for _, _, o, _ in rows]
    assert np.load(f"{tmp_path}/a/{artifacts.NEGATIVES_FILE}").tolist() == [n or [0] * 4 for _, _, _, n in rows]
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted([artifacts.POOL_FILE, artifacts.OFFSETS_FILE, artifacts.NEGATIVES_FILE])
    found = artifacts.read_artifacts(spark, f"{base}/a", 50, 3)
    assert sorted(map(tuple, artifacts.pool_rows(found).collect())) == [(i, at, sid) for i, p, _, _ in rows for at, sid in enumerate(p)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sliced = artifacts.slice_rows(found, found.select("interaction_id").where("interaction_id % 5 = 0"))
    assert {r["interaction_id"]: r["offsets"] for r in sliced.collect()} == {i: o for i, _, o, _ in rows if i % 5 == 0}
    assert "Join" not in plan(found) and "Broadcast" not in plan(sliced)  # nothing goes through the driver here either
    artifacts.write_artifacts(table([]), f"{base}/none", 0, 3)
    assert artifacts.read_artifacts(spark, f"{base}/none", 0, 3).count() == 0
    wide, twice = [(0, [1, 2, 3, 4], [1] * 5, None)], [rows[0], rows[1], rows[1]]
    for n, bad in ((1, wide), (3, twice), (51, rows), (49, rows), (49, rows[1:]), (1, [(0, [2**31], [1] * 5, None)]), (1, [(0, [1], [1], None)])):
        with pytest.raises(ValueError):
            artifacts.write_artifacts(table(bad), f"{base}/bad", n, 3, block=7)


def test_settings_and_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("You are\na judge.\n")
    assert artifacts.read_prompt(spark, f"file://{tmp_path}/p.txt") == "You are\na judge.\n"
    (tmp_path / "s.json").write_text('{"a": {"b": 1}}')
    assert artifacts.merge_settings({"a": {"c": 2}, "d": 3}, artifacts.read_settings(spark, f"file://{tmp_path}/s.json"), {"d": None}) == {"a": {"c": 2, "b": 1}}


def test_plane_keeps_neighbours():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.05, (20, 5)), rng.normal(3, 0.05, (20, 5))]
    y = samples.embed_plane(x, 8, 250, 0)
    near = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(near, np.inf)
    assert sum(near[i].argmin() // 20 == i // 20 for i in range(40)) == 40


def test_tables_are_cleaned_up(spark, monkeypatch):
    df, path = storage.persist_path(spark.range(3).toDF("x"), "probe")
    assert df.count() == 3 and path.startswith("file://") and artifacts.exists(spark, path)
    storage.drop_path(spark, path)
    assert not artifacts.exists(spark, path) and path not in storage._written

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
