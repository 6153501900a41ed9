"""The suffix tree against a model by definition over dictionaries, its sums, and what it gains on held-out texts."""

import dataclasses
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from explainkit.llm import common, suffix_tree
from explainkit.llm.suffix_tree import CLASSES, DEPTH, DISCOUNT, Bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = Bounds(share=0.004, frequent=0.01, least=6, chunk_bytes=6000, unit_tokens=1500)
END = "\n"


def corpus():
    """Texts in which rare words are followed by what they were followed by before."""
    rng = random.Random(21)
    common = [f"w{i}" for i in range(12)]
    rare = [f"rare{i:03d}x{i % 7}" for i in range(150)]
    rows = []
    for d in range(260):
        words = []
        for _ in range(rng.choice([0, 1, 5, 30, 60])):
            words.append(rng.choice(common))
            if rng.random() < 0.35:
                r = min(int(rng.expovariate(0.03)), 149)
                words += [rare[r], common[r % 12]] if rng.random() < 0.8 else [rare[r]]
                if rng.random() < 0.5:
                    words.append(common[(r + len(words[-2])) % 12])
        rows.append((d, " ".join(words)))
    return rows + [(1000, None), (1001, "unseen w1 rare000x0 never"), (1002, "W1  w2\nw3")]


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Model:
    """The definition: a crown over symbols with least shares, branches under rare words by count."""

    def __init__(self, texts, bounds):
        self.b = bounds
        self.c = Counter(t for ts in texts for t in ts)
        n = self.n = sum(self.c.values())
        once, twice = (sum(v == k for v in self.c.values()) for k in (1, 2))
        self.d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.frequent = {w for w, k in self.c.items() if k >= max(1, bounds.frequent * n)}
        self.unknown = self.d * len(self.c) / n
        self.root = {w: (self.c[w] - self.d) / n for w in self.frequent}
        self.root["RARE"] = max(1 - sum(self.root.values()), self.unknown, 1e-9)
        self.least = max(bounds.least, bounds.share * n)
        uses = Counter(self.context(t) for ts in texts for t in ts)
        self.states = [{} for _ in range(DEPTH + 1)]
        known = self.known = [{()}, {(s,) for s, k in uses.items() if k >= self.least} | {("START",)}]
        spots = [(self.before(ts, i), self.symbol(ts[i])) for ts in texts for i in range(len(ts))]
        for size in range(1, DEPTH + 1):
            if size > 1:
                seen = Counter(b[:size] for b, _ in spots if len(b) >= size and b[: size - 1] in known[size - 1] and b[1:size] in known[size - 1])
                known.append({k for k, v in seen.items() if v >= self.least})
            mass, pairs = Counter(), defaultdict(Counter)
            for b, s in spots:
                if len(b) >= size and b[:size] in known[size] and all(b[:j] in known[j] for j in range(1, size)):
                    mass[b[:size]] += 1
                    pairs[b[:size]][s] += 1
            new = {}
            for k, m in mass.items():
                some = {s: v for s, v in pairs[k].items() if v >= max(2, self.least / 50)}
                if not some:
                    continue
                lower = {s: max(self.crown(k[:-1], s), 1e-12) for s in some}
                left, left_lower = max(m - sum(some.values()), 0), max(1 - sum(lower.values()), 1e-9)
                gain = sum(v * math.log(v / m / lower[s]) for s, v in some.items()) + left * math.log(max(left, 1e-9) / m / left_lower)
                if gain > 0.5 * len(some) * math.log(m):
                    share = {s: max(v - DISCOUNT, 0) / m for s, v in some.items()}
                    new[k] = (share, 1 - sum(share.values()))
            self.states[size] = new
        self.branches = [{}, {}, {}]
        for level in range(3):
            groups = defaultdict(list)
            for ts in texts:
                for i in range(1, len(ts)):
                    if self.branched(ts[i - 1]) and i >= level:
                        b = self.before(ts, i)
                        if len(b) > level and (level or self.c[ts[i - 1]] <= bounds.unit_tokens):
                            groups[ts[i - 1], *b[1 : level + 1]].append((self.symbol(ts[i]), self.share(ts, i, level)))
            for k, some in groups.items():
                n_of = Counter(s for s, _ in some)
                m = len(some)
                gain = sum(math.log(n_of[s] / m / p) for s, p in some)
                if m >= bounds.least and gain > 0.5 * len(n_of) * math.log(m):
                    share = {s: max(v - DISCOUNT, 0) / m for s, v in n_of.items()}
                    self.branches[level][k] = (share, 1 - sum(share.values()))

    def symbol(self, w):
        return w if w in self.frequent else "RARE"

    def context(self, w):
        raw = w.encode()
        return w if w in self.frequent else zlib.crc32(raw[-2:] if w.isascii() else w[-2:].encode()) % CLASSES

    def branched(self, w):
        return w not in self.frequent and self.c[w] >= self.b.least

    def before(self, ts, i):
        """Symbols before a token, nearest first, with the text's start."""
        return tuple([self.context(t) for t in ts[max(0, i - DEPTH) : i]][::-1] + (["START"] if i < DEPTH else []))

    def crown(self, b, s):
        p = self.root[s]
        for size in range(1, len(b) + 1):
            if size >= len(self.known) or b[:size] not in self.known[size]:
                break
            if b[:size] in self.states[size]:
                share, rest = self.states[size][b[:size]]
                p = share.get(s, 0) + rest * p
        return p

    def share(self, ts, i, levels=3):
        """The next symbol's probability, with branches of fewer than ``levels`` symbols."""
        b, s = self.before(ts, i), self.symbol(ts[i])
        p = self.crown(b[:DEPTH], s)
        if i and self.branched(ts[i - 1]):
            for level in range(levels):
                k = (ts[i - 1], *b[1 : level + 1])
                if len(k) == level + 1 and k in self.branches[level]:
                    share, rest = self.branches[level][k]
                    p = share.get(s, 0) + rest * p
        return p

    def score(self, ts):
        out = 0.0
        for i, t in enumerate(ts):
            own = 1.0 if t in self.frequent else ((self.c[t] - self.d) / self.n if self.c[t] else self.unknown) / self.root["RARE"]
            out += math.log10(self.share(ts, i) * own)
        return out


class Whole(Model):
    """The definition without shares: what the crown doesn't hold is in branches, by count."""

    def __init__(self, texts, bounds):
        super().__init__(texts, bounds)
        spots = [(ts, i, self.before(ts, i), self.symbol(ts[i])) for ts in texts for i in range(len(ts))]
        for size in range(1, DEPTH + 1):
            pairs = defaultdict(Counter)
            for _, _, b, s in spots:
                if len(b) >= size and all(b[:j] in self.known[j] for j in range(1, min(size + 1, len(self.known)))) and size < len(self.known):
                    pairs[b[:size]][s] += 1
            self.states[size] = {}
            new = {}
            for k, some in pairs.items():
                m = sum(some.values())
                lower = {s: max(self.crown(k[:-1], s), 1e-12) for s in some}
                gain = sum(v * math.log(v / m / lower[s]) for s, v in some.items())
                if gain > 0.5 * len(some) * math.log(m):
                    share = {s: max(v - DISCOUNT, 0) / m for s, v in some.items()}
                    new[k] = (share, 1 - sum(share.values()))
            self.states[size] = new
        self.branches = [{}, {}, {}]
        for level in range(3):
            groups = defaultdict(list)
            for ts, i, b, s in spots:
                if (k := self.branch(ts, i, level)) is not None:
                    groups[k].append((s, self.share(ts, i, level)))
            for k, some in groups.items():
                n_of, m = Counter(s for s, _ in some), len(some)
                gain = sum(math.log(n_of[s] / m / p) for s, p in some)
                if m >= bounds.least and gain > 0.5 * len(n_of) * math.log(m):
                    share = {s: max(v - DISCOUNT, 0) / m for s, v in n_of.items()}
                    self.branches[level][k] = (share, 1 - sum(share.values()))

    def branch(self, ts, i, level):
        """The context with ``level`` symbols before the last word, if a branch may hold it."""
        b = self.before(ts, i)[: level + 1]
        if not i or len(b) <= level:
            return None
        if self.branched(ts[i - 1]):
            return (ts[i - 1], *b[1:])
        return None if level + 1 < len(self.known) and all(b[: j + 1] in self.known[j + 1] for j in range(level + 1)) else ("symbol", *b)

    def share(self, ts, i, levels=3):
        b, s = self.before(ts, i), self.symbol(ts[i])
        p = self.crown(b[:DEPTH], s)
        for level in range(levels):
            k = self.branch(ts, i, level)
            if k in self.branches[level]:
                share, rest = self.branches[level][k]
                p = share.get(s, 0) + rest * p
        return p


@pytest.mark.parametrize("bounds", [SMALL, dataclasses.replace(SMALL, share=0.02, unit_tokens=300)])
def test_every_context_by_definition(spark, bounds):
    """Contexts that the crown leaves out for their share are in branches, whatever word they end in."""
    bounds = dataclasses.replace(bounds, every=True)
    rows = corpus() + [(2000 + i, f"w1 once{i}zz w7 once{i + 100}zz w7 w{i % 9} twice{i // 2}qq w3") for i in range(60)]
    rows += [(3000 + i, f"w2 one{i}vv w5 w{i % 7} w2 one{i}ww w5") for i in range(14)]
    train = [tokens_of(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    model = Whole(train, bounds)
    shared = Counter(k[1] in model.frequent for level in model.branches for k in level if k[0] == "symbol")
    assert min(shared[True], shared[False]) > 0, shared
    found = {r["doc_id"]: r for r in suffix_tree.text_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bounds).collect()}
    assert len(found) == len(rows)
    for d, text in rows:
        assert found[d]["score"] == pytest.approx(model.score(tokens_of(text)), abs=1e-6), (d, text)


def test_rare_context_of_frequent_words(spark):
    """What follows two frequent words is learned from twenty uses, though they are few among all tokens."""
    rng = random.Random(8)
    some = [f"v{i}" for i in range(40)]
    rows = [(d, " ".join(rng.choice(some) for _ in range(120)) + (" v1 v2 v3 v4" if d % 10 == 0 else "")) for d in range(250)]
    rows += [(1000, "v1 v2 v3 v4"), (1001, "v1 v2 v3 v5")]
    by_id = {r["doc_id"]: r["score"] for r in suffix_tree.text_scores(spark.createDataFrame(rows, "doc_id long, text string"), dataclasses.replace(suffix_tree.EVERY, share=0.01)).collect()}
    assert by_id[1000] > by_id[1001] + 0.3


@pytest.mark.parametrize("bounds", [SMALL, dataclasses.replace(SMALL, unit_tokens=25)])
def test_scores_by_definition(spark, bounds):
    """The second bounds make the commoner branched words too heavy for one task."""
    rows = corpus()
    train = [tokens_of(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    model = Model(train, bounds)
    found = {r["doc_id"]: r for r in suffix_tree.text_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bounds).collect()}
    assert len(found) == len(rows)
    assert sum(map(len, model.states)) > 5 and all(model.branches[:2])
    assert any(model.branched(w) and c > bounds.unit_tokens for w, c in model.c.items()) == (bounds is not SMALL)
    for d, text in rows:
        assert found[d]["score"] == pytest.approx(model.score(tokens_of(text)), abs=1e-6), (d, text)
    # other chunks, units and partitions give the same
    if bounds is not SMALL:
        return
    other = suffix_tree.text_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), dataclasses.replace(SMALL, chunk_bytes=10**7, unit_tokens=10**7))
    assert {r["doc_id"]: round(r["score"], 6) for r in other.collect()} == {d: round(r["score"], 6) for d, r in found.items()}


def test_definition_sums_to_one():
    rows = corpus()
    model = Model([tokens_of(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10], SMALL)
    rng = random.Random(3)
    texts = [ts for _, t in rows if len(ts := tokens_of(t)) > 3]
    for _ in range(60):
        ts = list(rng.choice(texts))
        i = rng.randrange(len(ts))
        total = 0.0
        for w in [*model.frequent, next(w for w in model.c if w not in model.frequent)]:
            ts[i] = w
            total += model.share(ts, i)
        assert total == pytest.approx(1, abs=1e-6)
    rare = [c for w, c in model.c.items() if w not in model.frequent]
    assert sum((c - model.d) / model.n for c in rare) + model.unknown == pytest.approx(model.root["RARE"], abs=1e-9)


def test_branches_grow_with_the_corpus(spark):
    rows = corpus()
    sizes = []
    for copies in (1, 3):
        more = [t for k in range(copies) for d, t in rows if zlib.crc32(str(d).encode()) % 10 for t in [" ".join(w + (f"_{k}" if w.startswith("rare") else "") for w in (t or "").split())]]
        sizes.append(sum(map(len, Model([tokens_of(t) for t in more], SMALL).branches)))
    assert sizes[1] > 2 * sizes[0] > 0


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for x in ([], [np.zeros(0, np.int64)], [rng.integers(-5, 2**40, 100), rng.integers(0, 9, 7).astype(np.uint16), np.arange(3, dtype=np.uint32)]):
        back = common.unpack(common.pack(*x))
        assert len(back) == len(x) and all(a.dtype == b.dtype and (a == b).all() for a, b in zip(x, back))


def test_held_out_texts_gain(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in suffix_tree.text_scores(real).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
