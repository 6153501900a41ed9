"""Operators that SQL can express, against their SQL; the pipeline against its operators' decisions."""

import duckdb
import pandas as pd
import pytest
from explainkit.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda df: sorted(map(repr, (tuple(round(float(x), 9) for x in r) for r in df.itertuples(index=False))))
    assert plain(got) == plain(want)


def test_pipeline(spark):
    """Every stage against SQL, brute force or a library, each on what the stage before kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    import sentencepiece

    from tests.llm.test_operators import WORD, brute_fingerprint, components

    docs = queries.read(spark, SF, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    kept, tables = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, kept, SF)
        assert found.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in found.collect()}
        tables.append(rows)
        kept = spark.createDataFrame(found.collect(), docs.schema)
    good, single, cut, clean = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.oracle_sql()['op4_quality_rules']}) WHERE kept").fetchall()}
    assert set(good) == want and len(good) > 0.5 * docs.count()
    prints = {d: brute_fingerprint(t) for d, t in good.items()}
    groups = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert single == {d: good[d] for d in set(groups.values())}
    # what is cut are words of the text, in order; no run of 60 words is left in two documents
    seen: dict = {}
    for d in sorted(single):
        before, after = WORD.findall(single[d]), WORD.findall(cut.get(d, ""))
        rest = iter(before)
        assert all(w in rest for w in after)
        assert d in cut or len(before) >= 50
        for i in range(len(after) - 59):
            assert seen.setdefault(tuple(w.lower() for w in after[i : i + 60]), d) == d
    con.register("cut", pd.DataFrame({"doc_id": [*cut], "text": [*cut.values()]}))
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM cut")
    bad = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({queries.oracle_sql()['op8_decontamination']})").fetchall()}
    assert clean == {d: t for d, t in cut.items() if d not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(clean)
    for r in out:
        ids = library.encode(clean[r["doc_id"]], add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
