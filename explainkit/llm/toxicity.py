"""Toxicity by a weighted finite-state pattern grammar.

Five machines read the classes of a clause's tokens: insult, threat, target, negation and reported speech.
Each is a table of states with, on every arc, an own weight and a factor. They are composed once into one
machine whose arcs carry the sum of the own weights, each times the others' factors: an insult counts by its
lexicon weight, more if a target stands before it and again if one follows, a threat only with a target after
it; within reach of a negation, or behind a verb of reporting, an arc counts for a fraction. A clause's score
is the weight of its path; words outside such clauses don't count. A document's features are its clauses'
scores summed, the strongest one, and how many there are.

The insult lexicon has seeds, and whole words and stems learned from labelled rows: those that occur in toxic
texts far more than chance allows, weighted by log-odds. How much each feature weighs is fitted by logistic
regression with weights of zero or more. Both use a sample of at most ``SAMPLE`` labelled rows (a documented
bound, drawn by hash).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.llm.common import crc_mod, id_and_text, map_rows
from explainkit.plans.storage import persist_table

#: Labelled rows that the lexicon and the weights are learned from, at most (in expectation, by hash).
SAMPLE = 24_000
#: Prefix lengths that may be stems, and the least length of a whole word of the lexicon.
STEM, WORD = range(5, 10), 3

#: Seed lexicons of the grammar (English, German, French, Spanish).
INSULTS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb imbecile bastard filth vermin "
    "dummkopf trottel abschaum arschloch widerlich crétin ordure salaud connard minable estúpido imbécil basura escoria asqueroso"
).split()
THREATS = "kill hurt destroy beat punch shoot stab burn hang strangle töten umbringen schlagen verletzen tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGETS = "you your you're yourself he she they them him her his their these those this that people everyone du dich dir dein deine ihr euch sie vous tu te toi ton votre ils elles tú ti usted ustedes vosotros ellos ellas él".split()
NEGATIONS = "not no never n't isn't aren't don't doesn't wasn't nor neither without kein keine keinen nicht nie niemals ohne ne pas jamais sans non ni nunca jamás sin tampoco".split()
REPORTS = "said says wrote writes claimed claims called quoted quotes according alleged reported told sagte schrieb behauptete nannte laut zitierte dit écrit affirme selon appelé cité dijo escribió afirmó según llamó citó".split()

_CLAUSE = re.compile(r"[.!?;:\n|]")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?", re.UNICODE)
#: Classes of tokens, the machines' input.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Tokens that a target, a threat and a negation reach; what a target before or after an insult and a threat to a
#: target add; factors of negated and reported arcs.
REACH, NEGATED_REACH = 4, 3
AIMED, FOLLOWED, THREATENED, NEGATED, REPORTED = 1.5, 1.0, 3.0, 0.25, 0.4
MACHINES = ("insult", "threat", "target", "negation", "reported")
FEATURES = ["total", "strongest", "clauses", "any"]


@dataclass
class Machine:
    """A weighted transducer: by state and input class, the next state, the arc's own weight, and the factor it
    puts on the other machines' weights. State 0 is the start; every state accepts."""

    step: list[list[int]]
    own: list[list[float]]
    factor: list[list[float]]

    def __matmul__(self, other: Machine) -> Machine:
        """The composition: states are the pairs that can be reached, arcs carry both machines' weights."""
        pairs, at = [(0, 0)], {(0, 0): 0}
        step, own, factor = [], [], []
        for a, b in pairs:  # grows while it is read
            row = []
            for c in range(6):
                pair = self.step[a][c], other.step[b][c]
                if pair not in at:
                    at[pair] = len(pairs)
                    pairs.append(pair)
                row.append(at[pair])
            step.append(row)
            own.append([self.own[a][c] * other.factor[b][c] + other.own[b][c] * self.factor[a][c] for c in range(6)])
            factor.append([self.factor[a][c] * other.factor[b][c] for c in range(6)])
        return Machine(step, own, factor)


def _fading(sets: int, reach: int) -> list[list[int]]:
    """States that count down from ``reach`` after a token of class ``sets``."""
    return [[reach if c == sets else max(0, s - 1) for c in range(6)] for s in range(reach + 1)]


def machines() -> dict[str, list[Machine]]:
    """The tables of the five machines (the target machine has a part for each side of the insult)."""
    ones = lambda n: [[1.0] * 6 for _ in range(n)]
    none = lambda n: [[0.0] * 6 for _ in range(n)]
    arcs = lambda n, c, weight: [[weight if s and k == c else 0.0 for k in range(6)] for s in range(n)]
    spent = lambda table: [[0 if c == TARGET else t for c, t in enumerate(row)] for row in table]
    insult = Machine([[0] * 6], [[float(c == INSULT) for c in range(6)]], ones(1))
    threat = Machine(spent(_fading(THREAT, REACH)), arcs(REACH + 1, TARGET, THREATENED), ones(REACH + 1))
    before = Machine(_fading(TARGET, REACH), none(REACH + 1), [[AIMED if s and c == INSULT else 1.0 for c in range(6)] for s in range(REACH + 1)])
    behind = Machine(spent(_fading(INSULT, REACH)), arcs(REACH + 1, TARGET, FOLLOWED), ones(REACH + 1))
    negation = Machine(_fading(NEGATION, NEGATED_REACH), none(NEGATED_REACH + 1), [[NEGATED if s else 1.0] * 6 for s in range(NEGATED_REACH + 1)])
    reported = Machine([[int(c == REPORT) for c in range(6)], [1] * 6], none(2), [[1.0] * 6, [REPORTED] * 6])
    return {"insult": [insult], "threat": [threat], "target": [before, behind], "negation": [negation], "reported": [reported]}


class Grammar:
    """The composed machine over one lexicon; ``off`` leaves machines out."""

    def __init__(self, stems: dict[str, float], words: dict[str, float] | None = None, off: Iterable[str] = ()) -> None:
        import ahocorasick

        self.stems, self.words = stems, words or {}
        self.longest = max(map(len, stems), default=0)
        self.least = min(map(len, stems), default=0)
        self.classes: dict[str, int] = {}
        for kind, some in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            for w in some:
                self.classes.setdefault(w, kind)
        used = [m for name, parts in machines().items() if name not in off for m in parts]
        self.machine = reduce(Machine.__matmul__, used)
        # cues that can give a clause a score; clauses without one are never read
        self.cues = ahocorasick.Automaton()
        for w in {*stems, *self.words, *THREATS}:
            self.cues.add_word(w, len(w))
        self.cues.make_automaton()

    def weight(self, word: str) -> float:
        """The lexicon weight of a word, or of the longest stem that it starts with."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(min(len(word), self.longest), self.least - 1, -1):
            found = self.stems.get(word[:n])
            if found is not None:
                return found
        return 0.0

    def tokens(self, text: str, start: int = 0, end: int | None = None) -> Iterable[tuple[int, float]]:
        """Class and lexicon weight of each token."""
        classes, weight = self.classes, self.weight
        for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
            word = m[0]
            kind = classes.get(word)
            if kind is not None:
                yield kind, 1.0
            elif word.endswith("n't"):
                yield NEGATION, 1.0
            else:
                w = weight(word)
                yield (INSULT, w) if w else (OTHER, 1.0)

    def clause_score(self, text: str, start: int = 0, end: int | None = None) -> float:
        """The weight of a clause's path."""
        step, own, state, score = self.machine.step, self.machine.own, 0, 0.0
        for kind, w in self.tokens(text, start, end):
            score += w * own[state][kind]
            state = step[state][kind]
        return score

    def features(self, text: str | None) -> list[float]:
        """What a document's clauses weigh together, the strongest clause, and how many weigh anything."""
        low = (text or "").lower()
        places = []
        for end, n in self.cues.iter(low):
            start = end - n + 1
            if start == 0 or not low[start - 1].isalnum():
                places.append(start)
        total = best = 0.0
        matched, upto = 0, -1
        marks = [m.start() for m in _CLAUSE.finditer(low)] if places else []
        for at in sorted(places):
            if at < upto:
                continue
            i = bisect_right(marks, at)
            upto = marks[i] if i < len(marks) else len(low)
            score = self.clause_score(low, marks[i - 1] + 1 if i else 0, upto)
            if score > 0:
                matched += 1
                total, best = total + score, max(best, score)
        return [math.log1p(total), best / 10, math.log1p(matched), float(matched > 0)]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``SAMPLE`` labelled training rows, chosen by hash; one row an id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > SAMPLE:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1e6 * SAMPLE / n)))
    return id_and_text(docs).join(marks, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _signature(words: list[str]) -> int:
    """The least hash of three neighbouring words: copies and near copies mostly share it."""
    import zlib

    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and whole words with their log-odds. Texts with one signature count once, so copies don't make their
    words part of it. All that pass the tests are kept: their number is bounded by the words of the sample."""

    def signed(cols: list[list]) -> list[list]:
        words = [_TOKEN.findall((t or "").lower()) for t in cols[1]]
        # a whole word is marked by a space behind it
        keys = [sorted({k for x in set(w) for k in (*(x[:n] for n in STEM if len(x) >= n), *([f"{x} "] if len(x) >= WORD else []))}) for w in words]
        return [cols[0], cols[2], [_signature(w) for w in words], keys]

    rows = map_rows(sample, ["doc_id", "text", "toxic"], signed, "doc_id long, toxic int, mark long, stems array<string>")
    once = persist_table(rows.groupBy("mark", "toxic").agg(F.min_by("stems", "doc_id").alias("stems")), "stems")
    count = dict(once.groupBy("toxic").count().collect())
    toxic, clean = count.get(1, 0), count.get(0, 0)
    seeds = dict.fromkeys((w for w in INSULTS if len(w) >= STEM[0]), 2.0), dict.fromkeys((w for w in INSULTS if len(w) < STEM[0]), 2.0)
    if not toxic:
        return seeds
    base = toxic / (toxic + clean)
    each = once.select("toxic", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    # log-likelihood ratio against the base rate: chance has to explain the best of very many prefixes
    p = F.col("bad") / F.col("all")
    gain = F.col("bad") * F.log(p / base) + F.when(p < 1, (F.col("all") - F.col("bad")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    found = each.where((F.col("bad") >= 3) & (p >= 0.7)).withColumn("gain", gain).where(F.col("gain") > math.log(20_000)).collect()
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    counts = {r["stem"]: (r["bad"], r["all"]) for r in found}
    # a stem that always goes on in the same way says no more than the longer one
    same = {key[:n] for key, n_of in counts.items() for n in range(STEM[0], len(key)) if counts.get(key[:n]) == n_of}
    for row in sorted(found, key=lambda r: (len(r["stem"]), r["stem"])):
        if row["stem"] in same:
            continue
        word = row["stem"].rstrip()
        if not any(word[:n] in stems for n in range(STEM[0], len(word) + 1)):
            odds = math.log((row["bad"] + 0.5) / (toxic + 1)) - math.log((row["all"] - row["bad"] + 0.5) / (clean + 1))
            (stems if word == row["stem"] else words)[word] = max(0.5, min(odds, 8.0))
    for table, some in zip((stems, words), seeds, strict=True):
        for seed, weight in some.items():  # seeds are stems, with what was learned of them as words
            if not any(seed[:n] in stems for n in range(STEM[0], len(seed) + 1)):
                table[seed] = words.get(seed, weight)
    return stems, words


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps with weights of zero or more; the last one is the bias, of any sign.
    A weight that comes out negative is set to zero and the others are fitted again."""
    x = np.c_[x, np.ones(len(x))]
    n = x.shape[1]
    if not len(y) or y.min() == y.max():
        return np.r_[np.ones(n - 1), -3.0]
    use = np.ones(n, dtype=bool)
    while True:
        part, w = x[:, use], np.zeros(int(use.sum()))
        penalty = np.r_[np.full(len(w) - 1, ridge), 1e-6]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hess = (part * (p * (1 - p))[:, None]).T @ part + np.diag(penalty + 1e-9)
            step = np.linalg.solve(hess, part.T @ (p - y) + penalty * w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(n)
        out[use] = w
        if (out[:-1] >= 0).all():
            return out
        use[:-1] &= out[:-1] >= 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[dict[str, float], dict[str, float]], np.ndarray]:
    """Lexicon and feature weights from the labelled sample."""
    sample = persist_table(_sample(docs, labels), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def work(cols: list[list]) -> list[list]:
        grammar = Grammar(*lexicon)
        return [cols[1], [grammar.features(t) for t in cols[0]]]

    rows = map_rows(sample, ["text", "toxic"], work, "toxic int, features array<double>").toPandas()
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return lexicon, fit_weights(x, rows["toxic"].to_numpy(dtype=float))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document.

    Null or empty text scores like a text without a matched clause; each row is answered, repeated rows
    too; of several training texts with one id the smallest is learned from, and an id is toxic if any label
    says so; a null id is held in training by its text ``null`` but has no label; extra columns don't
    matter; an empty table gives no rows; without labels the seed lexicon alone scores. Very long texts and
    clauses are read whole; a score of exactly 0.5 is predicted as 1.
    """
    lexicon, weights = train(docs, labels)
    held: list = []

    def work(cols: list[list]) -> list[list]:
        if not held:
            held.append(Grammar(*lexicon))
        z = np.array([held[0].features(t) for t in cols[1]], dtype=float).reshape(len(cols[0]), len(FEATURES)) @ weights[:-1] + weights[-1]
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [cols[0], [crc_mod(d, 5) == 0 for d in cols[0]], score, (score >= 0.5).astype(int)]

    return map_rows(id_and_text(docs), ["doc_id", "text"], work, "doc_id long, held_out boolean, score double, predicted int")
