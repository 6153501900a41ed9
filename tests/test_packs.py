"""The joint trainer's passes over packs, against tables and brute force."""

import numpy as np
import pytest
from explainkit import catalog
from explainkit.operators import factors, graph_model, packs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def said(spark):
    rng = np.random.default_rng(4)
    rows = [(n, int(rng.integers(9)) * 7, int(rng.integers(6)) * 5, [int(x) * 3 for x in rng.integers(0, 8, rng.integers(0, 4))]) for n in range(70)]
    return spark.createDataFrame([*rows, (70, 63, 30, None), (71, None, 5, [3]), (72, 7, 5, [3, None])], "interaction_id long, user_id long, item_id long, statement_ids array<long>")


def table(df):
    return {r["id"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("layers", [(0, 0), (1, 1), (2, 2), (4, 3)])
def test_forward_is_the_propagation_of_tables(said, layers):
    trainer = graph_model.JointGraph(said, dim=3, item_layers=layers[0], tag_layers=layers[1], pack_rows=9)
    model = trainer.forward(trainer.initial())
    rows = said.dropna(subset=["user_id", "item_id"]).withColumn("statement_ids", F.expr("filter(statement_ids, x -> x is not null)"))
    bought = rows.groupBy(F.col("user_id").alias("r"), F.col("item_id").alias("c")).agg(F.count("*").alias("w"))
    user, item, tag = (model.start[s] for s in graph_model.SIDES)
    want = {}
    for g, side, name in (("ua", user, "user_id"), ("ia", item, "item_id")):
        owners, tags = factors.propagate(factors.normalized_adjacency(factors.tag_matrix(rows, name)), side, tag, layers[1])
        want |= {f"{name.split('_')[0]}_{g}": table(owners), f"tag_{g}": table(tags)}
    plus = lambda start, more: said.sparkSession.createDataFrame([(i, [x + y for x, y in zip(v, more[i], strict=True)]) for i, v in table(start).items()], "id long, v array<double>")
    users, items = factors.propagate(factors.normalized_adjacency(bought), plus(user, want["user_ua"]), plus(item, want["item_ia"]), layers[0])
    want |= {"user_ui": table(users), "item_ui": table(items)}
    for name, vectors in want.items():
        got = table(model.final[name])
        assert set(got) == set(vectors)
        for i, v in vectors.items():
            assert got[i] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("side", graph_model.SIDES)
def test_gradient_of_two_layers(said, side):
    """A step's direction against finite differences of the loss, at one vector of each side."""
    trainer = graph_model.JointGraph(said, dim=2, item_layers=2, tag_layers=2, rate=1e-4, pack_rows=9)
    start = trainer.initial()
    after = trainer.step(start, 0)
    base, vectors, moved, slope = trainer.losses[-1], table(start.start[side]), table(after.start[side]), []
    one = sorted(vectors)[2]
    for k in range(2):
        nudged = [(i, [x + (1e-4 if i == one and j == k else 0) for j, x in enumerate(v)]) for i, v in vectors.items()]
        trainer.step(graph_model.Model({**start.start, side: said.sparkSession.createDataFrame(nudged, "id long, v array<double>")}), 0)
        slope.append((trainer.losses[-1] - base) / 1e-4)
    step = np.array(moved[one]) - np.array(vectors[one])
    assert np.dot(step, slope) / (np.linalg.norm(step) * np.linalg.norm(slope)) == pytest.approx(-1, abs=0.02)


def test_ndcg_from_ranks_of_truths(said):
    """The same as from whole lists of the best, with unknown users, items and statements among the truths."""
    trainer = graph_model.JointGraph(said, dim=3, item_layers=1, tag_layers=1, pack_rows=9)
    rows = [(100, 0, 10, [3, 3, 9]), (101, 7, 5, [0, 999]), (102, 7, 5, [21]), (103, 14, 25, [6, 9, 12]), (104, 777, 5, [3]), (105, 21, 999, [3]), (106, 28, 0, [])]
    judged = said.sparkSession.createDataFrame(rows, "interaction_id long, user_id long, item_id long, statement_ids array<long>")
    model = trainer.fit(1)
    items = judged.select(F.col("user_id").alias("id"), F.col("item_id").alias("thing"))
    tags = judged.select(F.col("interaction_id").alias("pair"), F.explode("statement_ids").alias("thing"))
    pairs = judged.select(F.col("interaction_id").alias("pair"), "user_id", "item_id")
    want = graph_model.ndcg(graph_model.recommend_items(model, 3), items, "id", 3), graph_model.ndcg(graph_model.recommend_tags(model, pairs, 3), tags, "pair", 3)
    assert trainer.ndcgs(model, trainer.truths(judged), 3) == pytest.approx(want, abs=1e-9) and min(want) > 0


def test_ranks_with_ties():
    rng = np.random.default_rng(1)
    things, owners = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float)
    truths = rng.integers(0, 40, 50)
    scores = owners @ things.T
    want = [1 + sum((scores[i, j], -j) > (scores[i, t], -t) for j in range(40)) for i, t in enumerate(truths)]
    got = packs.ranks_of(owners, truths, things, 10, block=4, cells=64)
    assert [x if x <= 10 else 11 for x in want] == [min(x, 11) for x in got.tolist()]


def test_search_ranks_truths_only(spark, monkeypatch):
    """No list of the best is made of all items for all users, and the gradient of the common start is computed once."""
    made = []
    monkeypatch.setattr(graph_model, "top_of_blocks", lambda *a, **b: made.append("list"))
    monkeypatch.setattr(graph_model.JointGraph, "_gradient", (lambda f: lambda self, *a: (made.append("gradient"), f(self, *a))[1])(graph_model.JointGraph._gradient))
    assert catalog.queries()["joint_search"](spark, "/root/testdata/sf0.001").count() == 2 and made == ["gradient"]


def test_segment_sums():
    rng = np.random.default_rng(0)
    size = np.r_[rng.integers(1, 9, 50), 200, 1, 64, 63]
    starts, x = np.cumsum(size) - size, rng.normal(size=(size.sum(), 3))
    assert np.allclose(packs.segment_sums(x, starts), np.add.reduceat(x, starts, axis=0)) and packs.segment_sums(x[:0], starts[:0]).shape == (0, 3)


def test_search_trains_the_whole_model(spark, monkeypatch):
    """The search's vectors and layers are the trainer's own, not smaller ones."""
    made = []
    monkeypatch.setattr(graph_model.JointGraph, "_number", (lambda f: lambda self, raw: (made.append((self.dim, self.item_layers, self.tag_layers)), f(self, raw))[1])(graph_model.JointGraph._number))
    catalog.queries()["joint_search"](spark, "/root/testdata/sf0.001").count()
    whole = graph_model.JointGraph
    assert made == [(whole.dim, whole.item_layers, whole.tag_layers)] == [(16, 2, 2)]
