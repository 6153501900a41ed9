from explainkit.operators import lsh


def test_minhash_groups_keep_every_link(spark):
    """Pairs at the threshold are grouped whatever else shares their bands, against brute force."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(40):
        base = [f"{w}x{g}" for w in words]
        rows += [(10 * g + 1, " ".join(base)), (10 * g + 2, " ".join(base[2:] + [f"end{g}"])), (10 * g + 3, " ".join(base[4:] + [f"end{g}", f"more{g}"])), (10 * g + 4, " ".join(base))]
    rows.append((1000, "one"))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    top = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    found = {r["id"]: r["group_id"] for r in lsh.minhash_groups(spark.createDataFrame(rows, "id long, text string"), 0.9).collect()}
    assert found == top and all(top[10 * g + 3] == 10 * g + 1 for g in range(40))


def test_sample_ranks_lay_out_no_candidates(spark, monkeypatch):
    """Ranks that depend on user and item, against all candidates of each sample; without any window over them."""
    import random

    from explainkit.operators import evaluate
    from explainkit.operators.popularity import CountRanker

    draw = random.Random(3)
    rows = [(i, draw.randrange(6), draw.randrange(4), [draw.randrange(-1, 31) for _ in range(draw.randrange(6))], draw.choice(["train", "test"])) for i in range(120)]
    splits = spark.createDataFrame(rows, "interaction_id long, user_id long, item_id long, statement_ids array<long>, split string")
    every, size, want = splits.drop("split"), 30, set()
    valid = lambda ids: {s for s in ids if 0 <= s < size}
    for name, (scorer, owner) in {"userpop": (1, 2), "itempop": (2, 1)}.items():
        for i, u, t, ids, split in rows:
            key = (u, t)
            pool = {s for r in rows if r[owner] == (key[owner - 1]) for s in valid(r[3])}
            count = lambda s, k=key[scorer - 1], n=scorer: sum(s in r[3] for r in rows if r[4] == "train" and r[n] == k)
            order = sorted(pool, key=lambda s: (-count(s), s))
            want |= {(name, i, s, order.index(s) + 1) for s in valid(ids) & pool if split == "test"}
    rankers = {name: evaluate.ranker_named(name, splits, size) for name in ("userpop", "itempop")}
    assert all(isinstance(r, CountRanker) for r in rankers.values())

    def never(*args):
        raise AssertionError("candidates are laid out for each sample")

    monkeypatch.setattr(evaluate, "rank_within", never)
    got = set()
    for name, paradigm in (("userpop", "item"), ("itempop", "user")):
        found = evaluate.positive_ranks(rankers[name], paradigm, splits, every, spark.range(size).withColumnRenamed("id", "sid"), size)
        got |= {(name, r["interaction_id"], r["sid"], r["rank"]) for r in found.collect()}
    assert got == want and len(got) > 100


def test_jaccard_pairs_fetch_a_class_once(spark, monkeypatch):
    """Exact pairs among many copies, near copies and other texts; copies are no candidates of each other."""
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[draw.choice(words) for _ in range(40)] for _ in range(6)]
    texts = [" ".join(b) for b in base for _ in range(12)] + [" ".join(b[1:]) for b in base] + [" ".join(b + ["end", f"of{i}"]) for i, b in enumerate(base)] + ["one", "", None, "A  b", "a b"]
    order = draw.sample(range(len(texts)), len(texts))
    rows = list(zip(order, texts, strict=True))
    sets = {i: {(a, b) for w in [(t or "").lower().split()] for a, b in zip(w, w[1:])} for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    tables, write = {}, lsh.persist_table

    def seen(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(lsh, "persist_table", seen)
    found = lsh.jaccard_pairs(spark.createDataFrame(rows, "id long, text string"), 0.9).collect()
    got = {(r["a"], r["b"]): r["jaccard"] for r in found}
    assert len(got) == len(found) and got == {p: j for p, j in want.items() if j >= 0.9}
    assert len(got) > 6 * 66 and tables["candidates"].count() < 60
