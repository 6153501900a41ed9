"""Pairwise factors whose statement vectors are gated by the statements' texts.

A statement has a vector for users and one for items; both are multiplied, place by place, with a linear map of its
text's encoding, so statements of like texts move together. Users are dealt to blocks; an epoch takes every block's
seeded steps side by side from the same tables and averages what the blocks made of each row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.operators.graph_model import top_of_blocks
from explainkit.plans.storage import persist_table

SCHEMA = "kind string, id long, v array<double>, b double"


def gated_factors(interactions: DataFrame, texts: DataFrame, statements: int, dim: int = 16, rate: float = 0.05, reg: float = 0.001, epochs: int = 3, batch: int = 64, seed: int = 0, block: int = 2000) -> DataFrame:
    """The model as one table ``(kind, id, v, b)`` over all ``interactions (interaction_id, user_id, item_id, statement_ids)``.

    Kinds: ``u`` users, ``i`` items, ``eu`` and ``ei`` statements with their biases, ``w`` rows of the linear map (the last
    one is its bias), ``t`` gates. ``texts (sid, hidden)`` are the encoded statements; their number is stated and fixed, and
    statement tables are all that reaches the driver.
    """
    hidden = np.zeros((statements, 0))
    rows = texts.where(F.col("sid").between(0, statements - 1)).select("sid", F.col("hidden").cast("array<double>").alias("h")).collect()
    if rows:
        hidden = np.zeros((statements, len(rows[0]["h"])))
        for r in rows:
            hidden[r["sid"]] = r["h"]
    hidden = np.c_[hidden, np.ones(statements)]
    draw = np.random.default_rng(seed)
    state = {"eu": draw.uniform(-0.1, 0.1, (statements, dim)), "ei": draw.uniform(-0.1, 0.1, (statements, dim)), "bu": np.zeros(statements), "bi": np.zeros(statements), "w": draw.uniform(-0.1, 0.1, (hidden.shape[1], dim))}
    state["w"][-1] += 1.0
    spark = interactions.sparkSession
    blocks = F.pmod(F.xxhash64("user_id"), F.lit(max(1, interactions.count() // block)))
    fed = persist_table(interactions.select(F.col("interaction_id").cast("long").alias("at"), F.col("user_id").cast("long").alias("u"), F.col("item_id").cast("long").alias("i"), F.col("statement_ids").cast("array<long>").alias("sids"), blocks.alias("block")), "gated")
    seen = lambda key, name: fed.select(key, F.explode("sids").alias("s")).groupBy(key).agg(F.collect_set("s").alias(name))
    fed = persist_table(fed.join(seen("u", "have_u"), "u", "left").join(seen("i", "have_i"), "i", "left"), "gated")
    owners = spark.createDataFrame([], SCHEMA)
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((hidden, state))

        def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # written before the next round
            hidden, start = sent.value
            t = {k: v.copy() for k, v in start.items()}
            pdf = pdf.sort_values("at")
            new = lambda kind, at: np.random.default_rng([seed, kind, int(at) & (2**63 - 1)]).uniform(-0.1, 0.1, dim)
            side, where = {}, {}
            for n, k in enumerate(("u", "i")):
                known = dict(zip(pdf[k], pdf[f"{k}_v"], strict=True))
                where[k] = {x: j for j, x in enumerate(sorted(known))}
                side[k] = np.array([np.array(known[x]) if known[x] is not None else new(n, x) for x in where[k]])
            pairs = [(where["u"][u], where["i"][i], int(s), set(hu), set(hi)) for u, i, sids, hu, hi in zip(pdf["u"], pdf["i"], pdf["sids"], pdf["have_u"], pdf["have_i"], strict=True) if sids is not None for s in sids if 0 <= s < statements]
            rng = np.random.default_rng([seed, 7, epoch, int(key[0])])
            other = lambda have: next((int(x) for x in rng.integers(0, statements, 64) if x not in have), int(rng.integers(statements)))
            order = rng.permutation(len(pairs))
            for at in range(0, len(order), batch):
                some = [pairs[j] for j in order[at : at + batch]]
                u, i, s = (np.array([p[n] for p in some]) for n in range(3))
                for owner, own, table, bias, no in (("u", u, "eu", "bu", np.array([other(p[3]) for p in some])), ("i", i, "ei", "bi", np.array([other(p[4]) for p in some]))):
                    gs, gn = hidden[s] @ t["w"], hidden[no] @ t["w"]
                    x, es, en = side[owner][own], t[table][s], t[table][no]
                    pull = 1 / (1 + np.exp(np.clip((x * (es * gs - en * gn)).sum(axis=1) + t[bias][s] - t[bias][no], -50, 50)))[:, None]
                    w = hidden[s].T @ (pull * x * es) - hidden[no].T @ (pull * x * en)
                    np.add.at(side[owner], own, rate * (pull * (es * gs - en * gn) - reg * x))
                    np.add.at(t[table], s, rate * (pull * x * gs - reg * es))
                    np.add.at(t[table], no, rate * (-pull * x * gn - reg * en))
                    np.add.at(t[bias], s, rate * pull[:, 0])
                    np.add.at(t[bias], no, -rate * pull[:, 0])
                    t["w"] += rate / len(some) * w
            out = [(k, int(x), side[k][j], 0.0) for k in ("u", "i") for x, j in where[k].items()]
            for k, b in (("eu", "bu"), ("ei", "bi")):
                moved = np.flatnonzero((t[k] != start[k]).any(axis=1) | (t[b] != start[b]))
                out += [(k, int(j), t[k][j], t[b][j]) for j in moved]
            out += [("w", j, row, 0.0) for j, row in enumerate(t["w"])]
            return pd.DataFrame(out, columns=["kind", "id", "v", "b"])

        known = lambda k, owners=owners: owners.where(F.col("kind") == k).select(F.col("id").alias(k), F.col("v").alias(f"{k}_v"))
        made = fed.join(known("u"), "u", "left").join(known("i"), "i", "left").groupBy("block").applyInPandas(step, SCHEMA)
        model = persist_table(made.groupBy("kind", "id").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(dim)]).alias("v"), F.avg("b").alias("b")), "gated")
        owners = model.where("kind in ('u', 'i')")
        for r in model.where("kind in ('eu', 'ei', 'w')").collect():  # statements and the map's rows
            state[r["kind"]][r["id"]] = r["v"]
            if r["kind"] != "w":
                state["b" + r["kind"][1]][r["id"]] = r["b"]
    gate = hidden @ state["w"]
    held = [(k, j, state[k][j].tolist(), float(state["b" + k[1]][j])) for k in ("eu", "ei") for j in range(statements)]
    held += [("w", j, row.tolist(), 0.0) for j, row in enumerate(state["w"])] + [("t", j, row.tolist(), 0.0) for j, row in enumerate(gate)]
    return owners.unionByName(spark.createDataFrame(held, SCHEMA))


def best_gated(model: DataFrame, pairs: DataFrame, k: int, mu: float = 0.7) -> DataFrame:
    """``(pair, thing, score, rank)``: the best statements of ``pairs (pair, user_id, item_id)``; both sides' scores are blended by ``mu``."""
    part = lambda kind, *names: model.where(F.col("kind") == kind).select("id", F.col("v").alias(names[0]), *([F.col("b").alias(names[1])] if len(names) > 1 else []))
    gated = lambda v: F.zip_with(v, "t", lambda x, y: x * y)
    things = part("eu", "eu", "bu").join(part("ei", "ei", "bi"), "id").join(part("t", "t"), "id")
    things = things.select("id", F.concat(gated("eu"), gated("ei"), F.array(F.col("bu") * mu + F.col("bi") * (1 - mu))).alias("v"))
    scaled = lambda c, by: F.transform(c, lambda x: x * by)
    owners = pairs.join(part("u", "x").withColumnRenamed("id", "user_id"), "user_id").join(part("i", "y").withColumnRenamed("id", "item_id"), "item_id")
    owners = owners.select(F.col("pair").alias("id"), F.concat(scaled("x", mu), scaled("y", 1 - mu), F.array(F.lit(1.0))).alias("v"))
    return top_of_blocks(owners, things, k).withColumnRenamed("id", "pair")
