"""The grammar's machines: composition against its definition, what each machine does, long clauses, held-out labels."""

import random

import pytest
from explainkit.llm import toxicity
from explainkit.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, Grammar, Machine

LEXICON = {"vekka": 2.0}, {"zur": 3.0}
WORDS = {OTHER: "blim", INSULT: "vekkaling", THREAT: "kill", TARGET: "you", NEGATION: "not", REPORT: "said"}


def brute_score(kinds, off=()):
    """A clause's weight by the definition of each machine, token by token."""
    total = 0.0
    for i, kind in enumerate(kinds):
        factor = 1.0
        if "negation" not in off and NEGATION in kinds[max(0, i - 3) : i]:
            factor *= toxicity.NEGATED
        if "reported" not in off and REPORT in kinds[:i]:
            factor *= toxicity.REPORTED
        if kind == INSULT and "insult" not in off:
            total += factor * 2.0 * (toxicity.AIMED if "target" not in off and TARGET in kinds[max(0, i - 4) : i] else 1.0)
        if kind == TARGET:  # what came since the last target, within reach
            since = kinds[max(0, i - 4) : i]
            since = since[len(since) - since[::-1].index(TARGET) :] if TARGET in since else since
            total += factor * (toxicity.THREATENED * (THREAT in since and "threat" not in off) + toxicity.FOLLOWED * (INSULT in since and "target" not in off))
    return total


def test_composition_is_its_definition():
    rng = random.Random(4)
    for off in ((), *((m,) for m in toxicity.MACHINES), ("negation", "target")):
        grammar = Grammar(*LEXICON, off=off)
        for _ in range(400):
            kinds = [rng.choice([OTHER, OTHER, *WORDS]) for _ in range(rng.randint(0, 14))]
            assert grammar.clause_score(" ".join(WORDS[k] for k in kinds)) == pytest.approx(brute_score(kinds, off)), (off, kinds)


def test_composition_is_associative():
    a, b, c = (toxicity.machines()[m][0] for m in ("insult", "negation", "reported"))
    run = lambda m, kinds: [m.own[s][k] for s, k in _walk(m, kinds)]

    def _walk(m: Machine, kinds):
        s = 0
        for k in kinds:
            yield s, k
            s = m.step[s][k]

    rng = random.Random(1)
    for _ in range(100):
        kinds = [rng.randrange(6) for _ in range(12)]
        assert run((a @ b) @ c, kinds) == pytest.approx(run(a @ (b @ c), kinds))


def test_what_each_machine_does():
    score = Grammar(*LEXICON).clause_score
    assert score("a vekka came") == 2.0 and score("a zur came") == 3.0 and score("a zurling came") == 0.0
    assert score("you are a vekka") == 3.0
    assert score("a vekka like you") == 3.0
    assert score("she is not a vekka") < score("she is a vekka")
    assert score("the paper said that a certain very odd vekka came") == pytest.approx(0.8)
    assert score("i will kill you") == 3.0 and score("kill the process") == 0.0
    assert 0 < score("i don't kill you") < 1
    whole = Grammar(*LEXICON)
    for machine, text, raises in (("insult", "a vekka came", False), ("threat", "we kill you", False), ("target", "you vekka", False), ("negation", "not a vekka", True), ("reported", "he said a vekka", True)):
        less = Grammar(*LEXICON, off=[machine]).features(text)[0]
        assert (less > whole.features(text)[0]) == raises and less != whole.features(text)[0], machine


@pytest.mark.parametrize("n", [900, 1200, 30_000])
def test_long_clauses_are_read_whole(n):
    grammar = Grammar(*LEXICON)
    assert grammar.features("she said" + " blim" * n + " vekka")[1] == pytest.approx(0.08)
    assert grammar.features("she said it." + " blim" * n + " vekka")[1] == pytest.approx(0.2)
    assert grammar.features("vekka" + " blim" * n + " vekka")[:2] == pytest.approx(grammar.features("vekka blim blim blim blim blim vekka")[:2])


def test_weights_never_lower_a_score():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(400) > 0).astype(float)
    w = toxicity.fit_weights(x, y)
    assert (w[:-1] >= 0).all() and w[0] > 1 and w[1] == 0


def test_machines_on_held_out_labels(spark):
    """Clean documents hold insults that are negated or reported, toxic ones plain and aimed ones and threats."""
    rng = random.Random(9)
    fill = lambda n: " ".join("".join(rng.choice("aeioubdgklmnprstvz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    clean = ["he is not a vekkaling", "they said a vekkaling came", "never a vekkaling", "kill the process"]
    toxic = ["you are a vekkaling", "what a vekkaling you are", "vekkaling and vekkaling"]
    rows, labels = [], []
    for i in range(900):
        y = i % 3 == 0
        rows.append((i, f"{fill(20)}. {rng.choice(toxic if y else clean)}. {fill(20)}." if y or i % 10 == 1 else f"{fill(34)}."))
        labels.append((i, int(y)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    (stems, words), weights = toxicity.train(docs, marks)
    assert all(len(s) >= 5 for s in stems) and (weights[:-1] >= 0).all()
    held = [(t, y) for (i, t), (_, y) in zip(rows, labels) if toxicity.crc_mod(i, 5) == 0]
    logit = lambda g, t: sum(a * b for a, b in zip(g.features(t), weights)) + weights[-1]
    full = Grammar(stems, words)
    right = sum((logit(full, t) >= 0) == bool(y) for t, y in held)
    assert right > 0.95 * len(held)
    probes = held + [("now i kill you", 1)]
    for machine in toxicity.MACHINES:
        less = Grammar(stems, words, off=[machine])
        assert any(abs(logit(full, t) - logit(less, t)) > 1e-6 for t, _ in probes), machine
