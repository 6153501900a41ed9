"""Queries that SQL can't express, against plain Python on the small tables."""

import html
import json
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from explainkit import catalog
from explainkit.functions import models

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_unescaped_pages(spark):
    want = {i: unicodedata.normalize("NFKC", html.unescape(h)) for i, h in table("pages", "page_id, html")}
    assert {r["page_id"]: r["text"] for r in run(spark, "html_nfkc")} == want


def extracted():
    """Statements of every document by the stand-in, from the prompt's first 128 words."""
    out = {}
    for i, text in table("documents", "doc_id, text"):
        words = text.split()
        body = " ".join(words[:128]) if len(words) > 128 else text
        answer = models.SentenceExtractor().generate([f"Title: {text[:20]} - Review: {body}\nOutput:"])[0]
        found = re.search(r"(?s)\[\s*\{.*?\}\s*\]", answer)
        try:
            out[i] = json.loads(found[0]) if found else None
        except ValueError:
            out[i] = None
    return out


def test_extracted_and_verified_statements(spark):
    want = extracted()
    got = {r["row_id"]: r["statements"] for r in run(spark, "llm_extract")}
    readable = [i for i, s in want.items() if s]
    assert set(got) == set(want) and len(readable) > 50
    assert sum((json.loads(got[i]) if got[i] else None) == want[i] for i in readable) >= 0.98 * len(readable)
    counts = {r["row_id"]: r["n"] for r in run(spark, "llm_verify")}
    kept = [i for i in readable if counts[i] is not None and counts[i] >= 0]
    assert set(counts) == set(want) and 0 < len(kept) < len(readable)
    for i in kept:
        distinct = {" ".join(s["statement"].lower().split()) for s in want[i] if len(s["statement"].split()) >= 4}
        assert counts[i] <= len(distinct)


def test_encoded_texts(spark):
    rows = table("benchmark", "item_id, text")
    want = dict(zip([r[0] for r in rows], models.HashedEncoder().encode([r[1] for r in rows])))
    for r in run(spark, "embed_texts"):
        assert np.allclose([float(x) for x in r["embedding"].split(",")], want[r["item_id"]], atol=1e-4)


def test_verifier_drops_repeats_and_breaks_off():
    item = lambda s: {"statement": s, "sentiment": "neutral"}
    prompts = [f"Input JSON:\n{json.dumps({'statements': [item('The Cat sat down'), item('the cat  sat down'), item('too short')]})}{' ' * k}\nOutput:" for k in range(17)]
    answers = models.RuleVerifier().generate(prompts)
    whole = [a for a in answers if a.startswith("Here it is: ")]
    assert len(whole) == 16
    assert all(json.loads(a.removeprefix("Here it is: ")) == {"statements": [item("the cat sat down")]} for a in whole)


@pytest.mark.parametrize("name", ["greedy_groups", "refine_components"])
def test_groups_cover_every_row_once(spark, name):
    rows = run(spark, name)
    key = "group_id" if name == "greedy_groups" else "cluster_id"
    ids = [(r["role"], r["id"]) if name == "greedy_groups" else r["id"] for r in rows]
    assert len(set(ids)) == len(ids) and all(r[key] <= r["id"] for r in rows)
    heads = {(r["role"], r[key]) if name == "greedy_groups" else r[key] for r in rows if r[key] == r["id"]}
    assert heads == {(r["role"], r[key]) if name == "greedy_groups" else r[key] for r in rows}
