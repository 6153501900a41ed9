"""Every pipeline stage on odd tables: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random

import pytest
from explainkit.llm import containment, passages, pieces, quality, queries, simhash

CLASHES = ["cut_lang", "symbol_ratio_cut", "_quality_n_words", "_QUALITY_kept", "_passages", "_passage_doc", "_kept_id", "kept", "n", "of", "marks", "again", "chosen", "fp", "least", "component", "a.b", "h"]
STAGES = {
    "quality": quality.keep_good,
    "near": simhash.keep_one,
    "passages": passages.remove_repeats,
    "benchmark": lambda d: containment.keep_uncontaminated(d, d.sparkSession.createDataFrame([(1, "one two three four five six seven", "x")], "item_id long, text string, h string")),
    "pieces": lambda d: pieces.piece_digests(d, queries.vocabulary(queries.PIECES)),
}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "and", "of"]) if rng.random() < 0.3 else "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    texts = [prose(i, 120) for i in range(12)]
    long_text = prose(99, 250_000)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, None), (21, ""), (22, " \n\t"), (23, long_text), (24, "x" * 2_000_000), (None, texts[0]), (None, None), (3, texts[3]), (3, texts[3]), (4, texts[5]), (30, texts[6] + " " + prose(300, 60))]
    return [(d, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASHES)]).repartition(2)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(odd, name):
    found = STAGES[name](odd)
    rows = found.collect()
    if name != "pieces":
        assert found.columns == odd.columns
        assert all(r[c] == f"v{i}" for r in rows for i, c in enumerate(CLASHES))
        assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert STAGES[name](odd.limit(0)).count() == 0
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    nulls = sum(r["doc_id"] is None for r in rows)
    every = sorted(r[0] for r in odd_rows() if r[0] is not None)
    if name == "quality":  # wordless texts go
        assert {20, 21, 22, 24}.isdisjoint(ids) and {0, 1, 3, 23} <= set(ids) and ids.count(3) == 3 and nulls == 1
    elif name == "near":  # copies and all wordless texts but one go; rows without an id stay
        assert nulls == 2 and ids.count(3) == 1 and ids.count(20) == 1 and {21, 22}.isdisjoint(ids) and 23 in ids
    elif name == "passages":  # copies of a whole text go; of an id's texts the smallest counts
        assert nulls == 2 and {20, 21, 22, 23, 24} <= set(ids) and ids.count(3) == 3
        kept = {(r["doc_id"], r["text"]) for r in rows}
        texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None and r[0] != 4}
        assert (23, texts[23]) in kept and (24, texts[24]) in kept
        assert next(r["text"] for r in rows if r["doc_id"] == 30) == prose(300, 60)
    elif name == "benchmark":
        assert ids == every and nulls == 2
    else:
        assert len(rows) == len(odd_rows())


def test_repeated_ids_keep_their_passages(spark):
    """An id with two texts: the smaller one's passage is found and cut, the other text stays."""
    passage = prose(7, 80)
    first, second = f"aaa {prose(8, 60)} {passage}", f"zzz {prose(9, 90)}"
    rows = [(1, f"{prose(10, 50)} {passage} {prose(11, 50)}"), (2, first), (2, second)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert [(r["doc_id"], r["owner_id"]) for r in found] == [(2, 1)] and found[0]["end_word"] - found[0]["start_word"] >= 80
    out = {r["text"] for r in passages.remove_repeats(docs).collect()}
    assert second in out and rows[0][1] in out and first not in out and any(t.startswith("aaa") and passage not in t for t in out)
    kept = simhash.keep_one(spark.createDataFrame([(5, prose(1, 80)), (5, prose(2, 80)), (6, prose(1, 80))], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(5, min(prose(1, 80), prose(2, 80)))]


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in (("all", odd), ("none", odd.limit(0)), ("null", odd.where("text is null"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(out) > 10) == (name == "all") and (name == "all" or not out)
