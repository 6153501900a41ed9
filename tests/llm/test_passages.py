"""Repeated passages against brute force: exact runs, identities of what is found, recall of fuzzy ones, layout of chunks."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from explainkit.llm import passages
from explainkit.llm.common import Memo

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def new(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def common(a, b):
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for u in a:
        last = row.copy()
        for j, v in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if u == v else max(last[j], row[j - 1])
    return int(row[-1])


def corpus(rng):
    """Documents that share passages of 20 to 120 words, some changed, some of them in pieces."""
    shared = [new(rng, rng.choice([20, 49, 50, 51, 64, 120])) for _ in range(14)]
    phrases = [new(rng, 7) for _ in range(5)]
    rows = []
    for d in range(90):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += new(rng, rng.randint(5, 60)) + rng.choice(phrases)
            if rng.random() < 0.5:
                p = list(rng.choice(shared))
                kind = rng.random()
                if kind < 0.3:
                    for i in rng.sample(range(len(p)), len(p) // 12):
                        p[i] = new(rng, 1)[0]
                elif kind < 0.4:
                    del p[rng.randrange(len(p))]
                elif kind < 0.5:
                    p = p[: len(p) // 2]
                words += p
        rows.append((d * 7 % 90, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, " \n"), (204, "short text"), (205, "The " * 300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(31))


@pytest.fixture(scope="module")
def found(spark, rows):
    return passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()


def test_exact_repeats_by_brute_force(rows, found):
    """The 50-word runs that an earlier document holds are inside passages found; at most one of 200 isn't, where several
    earlier documents hold changed copies of it."""
    words = {d: tokens(t) for d, t in rows}
    held, missed, total = {}, 0, 0
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for d in sorted(words):
        w = words[d]
        own = {}
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if key in held:
                total += 1
                missed += not any(a <= i and i + 50 <= b for a, b in spans.get(d, []))
            own.setdefault(key, d)
        for key, x in own.items():
            held.setdefault(key, x)
    assert total > 300 and missed <= total / 200


def test_what_is_found_is_alike(rows, found):
    words = {d: tokens(t) for d, t in rows}
    assert len(found) > 25
    for r in found:
        x, y = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["owner_id"]][r["owner_start"] : r["owner_end"]]
        assert r["owner_id"] < r["doc_id"] and len(x) == r["end_word"] - r["start_word"] >= 50 and len(y) == r["owner_end"] - r["owner_start"]
        assert r["matched"] <= common(x, y)
        columns = r["matched"] / r["identity"]
        assert columns >= max(len(x), len(y)) - 1e-6 and r["identity"] >= 0.8


@pytest.mark.parametrize("partitions", [1, 9])
def test_layout_matters_little(spark, rows, found, monkeypatch, partitions):
    """One chunk or many: nearly the same words are found to repeat (owners may differ, and so may the edges)."""
    cover = lambda some: {(r["doc_id"], i) for r in some for i in range(r["start_word"], r["end_word"])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    monkeypatch.setattr(passages, "UNIT_WORDS", 700)
    other = passages.repeated_passages(docs).collect()
    assert len(cover(other) ^ cover(found)) < 0.06 * len(cover(found))


@pytest.mark.parametrize(("size", "least"), [(52, 0.95), (60, 0.97), (80, 0.99)])
def test_recall_at_the_least_identity(spark, size, least):
    """Passages with every fifth word another one, at random places: one earlier holder."""
    rng = random.Random(size)
    rows = []
    for d in range(150):
        p = new(rng, size)
        q = list(p)
        for i in rng.sample(range(size), size // 5):
            q[i] = new(rng, 1)[0]
        rows += [(d, " ".join(new(rng, 80) + p + new(rng, 80))), (1000 + d, " ".join(new(rng, 80) + q + new(rng, 80)))]
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert min(got) >= 1000 and len(got) >= least * 150, len(got)


def test_winnowing_covers_every_window():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 5, 9, 10, 200, 36, 49, 50, 51, 1])
    words = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    h, at, kind = passages.seeds(words, sizes)
    for k, window, of in ((passages.WORDS, passages.WINDOW, 0), (passages.RUN, passages.RUNS, 1)):
        places = set(at[kind == of].tolist())
        for a, n in zip(starts.tolist(), sizes.tolist()):
            shingles = range(a, a + n - k + 1)
            for i in range(a, a + n - k - window + 2):
                assert places & set(range(i, i + window))
            assert not len(shingles) or places & set(shingles)
        assert all(any(a <= p and p + k <= a + n for a, n in zip(starts, sizes)) for p in places)
    again, _, _ = passages.seeds(words[starts[5] : starts[5] + 200], np.array([200]))
    mine = (at >= starts[5]) & (at < starts[5] + 200)
    assert sorted(again.tolist()) == sorted(h[mine].tolist())
    run = passages.run_hashes(np.r_[words[:40], words[:40]], 36)
    assert run[0] == run[40] and len(set(run.tolist())) == len(run) - 5


def peak(work):
    """What ``work`` returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_chunk_is_winnowed_in_bounded_memory():
    """The seeds of some whole texts at a time are those of all texts at once, with fewer arrays of the chunk's length."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 600, 5000)
    sizes[[7, 8, 300]] = 0, 300_000, 0
    words = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    some, least = peak(lambda: passages.seeds(words, sizes))
    assert least < 32 * len(words), least / len(words)
    whole = passages._seeds(words, sizes)
    for x, y in zip(some, whole, strict=True):
        assert (x[np.lexsort(some[:0:-1])] == y[np.lexsort(whole[:0:-1])]).all()
    assert len(passages.seeds(words[:0], sizes[:1] * 0)[0]) == len(passages.seeds(words[:0], sizes[:0])[0]) == 0


@pytest.mark.parametrize("ranges", [1, 40])
def test_a_unit_is_matched_in_bounded_memory(monkeypatch, ranges):
    """Ranges of hashes give what one sort of a whole unit gives, in less memory."""
    rng = np.random.default_rng(6)
    n, parts = 400_000, []
    for k in range(10):
        h = np.unique(rng.integers(0, 2**64, 2 * n // 5, dtype=np.uint64) >> np.uint64(46) << np.uint64(46))  # many are held by several chunks
        parts.append([h, rng.integers(0, 2**40, len(h)), rng.integers(0, 2**16, len(h)).astype(np.uint32)])
    h, doc, pos = (np.concatenate([p[k] for p in parts]) for k in range(3))
    monkeypatch.setattr(passages, "SORTED", len(h) // ranges)
    order, new, first = passages.firsts(h, doc, pos)
    of = np.repeat(np.arange(10), [len(p[0]) for p in parts])
    copies = [[x.copy() for x in p] for p in parts]
    (docs, places, part, mine, other), most = peak(lambda: passages.later_holders(copies))
    assert not copies and (docs == doc).all() and (places == pos).all() and (part == of).all()
    assert len(mine) > n and (mine == order[~new]).all() and (other == first[~new]).all()
    assert (most < 48 * len(h)) == (ranges > 1), most / len(h)


def test_memos_rest():
    """An operator without a memo empties those of the last one."""
    from explainkit.llm import shingles

    shingles.word_hashes("some words to keep")
    assert shingles._memo and Memo.busy is shingles._memo
    Memo.rest()
    assert not shingles._memo and not shingles._memo.chars and Memo.busy is None
    assert len(shingles.word_hashes("some words to keep")) == 4 and Memo.busy is shingles._memo
