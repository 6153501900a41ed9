"""Model inference behind vectorised interfaces.

A backend is a class with a method over a batch of texts; it is shipped by pickle and made ready once in
each Python worker. The offline stand-ins here are deterministic and need no weights.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from explainkit.functions.json_text import STATEMENTS, coerce_payload, first_array, verdict


class StatementExtractor(Protocol):
    """Generates raw text with a JSON array of statements for each prompt."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class StatementVerifier(StatementExtractor, Protocol):
    """Generates a cleaned statements object for each payload prompt."""


class TextEncoder(Protocol):
    """Encodes texts as unit vectors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """Scores text pairs between 0 and 1."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class SentenceExtractor:
    """Stand-in: each sentence is a statement; mood by a few words."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            body = p.split(" - Review: ", 1)[-1].removesuffix("\nOutput:")
            found = [s.strip() for s in re.split(r"[.!?\n]+", body) if len(s.split()) >= 3]
            mood = lambda s: "negative" if re.search(r"\b(not|bad|poor|broke)\b", s, re.I) else "positive" if re.search(r"\b(good|great|love|nice)\b", s, re.I) else "neutral"
            out.append(json.dumps([{"statement": s, "sentiment": mood(s)} for s in found]))
        return out


class RuleVerifier:
    """Stand-in verifier: brings statements to lower case, drops those of fewer than four words and repeats, and (like a
    model at times) breaks off its answer for prompts whose length is a multiple of 17."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            payload = json.loads(p.removeprefix("Input JSON:\n").removesuffix("\nOutput:"))
            kept: dict[str, dict] = {}
            for s in payload.get("statements", []):
                words = str(s.get("statement", "")).lower().split()
                if len(words) >= 4:
                    kept.setdefault(" ".join(words), {"statement": " ".join(words), "sentiment": s.get("sentiment")})
            answer = json.dumps({"statements": [*kept.values()]})
            out.append(answer[: len(answer) // 2] if len(p) % 17 == 0 else "Here it is: " + answer)
        return out


class HashedEncoder:
    """Stand-in: hashed words and word pairs, normalised."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            w = (text or "").lower().split()
            for g in [*w, *map(" ".join, zip(w, w[1:]))]:
                h = zlib.crc32(g.encode())
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class JaccardScorer:
    """Stand-in: word-set overlap."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [({*(a or "").lower().split()}, {*(b or "").lower().split()}) for a, b in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


class ClauseJudge:
    """Stand-in judge: atomic if no joining word, explanatory if not in the first person."""

    def generate(self, prompts: list[str]) -> list[str]:
        atomic = lambda p: int(not re.search(r"\b(and|but|or|because|while)\b|;", p, re.I))
        plain = lambda p: int(not re.search(r"\b(i|me|my|we|us|our)\b", p, re.I))
        return [json.dumps({"atomicity": atomic(p), "explainatoriness": plain(p)}) for p in prompts]


def generate_column(df: DataFrame, prompt: str, out: str, model: StatementExtractor) -> DataFrame:
    """``df`` with the model's raw output for a prompt column; null prompts give null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            have = s.notna()
            found = pd.Series([None] * len(s), index=s.index, dtype=object)
            if have.any():
                found[have] = model.generate(s[have].tolist())
            yield found

    return df.withColumn(out, run(prompt))


def extract_statements(reviews: DataFrame, model: StatementExtractor, max_words: int = 128) -> DataFrame:
    """``reviews`` with ``statements``; null where nothing could be read from the output."""
    from explainkit.functions.text import review_prompt

    asked = reviews.withColumn("_prompt", review_prompt(F.col("review_title"), F.col("review"), max_words))
    found = generate_column(asked, "_prompt", "_raw", model)
    return found.withColumn("statements", F.from_json(first_array(F.col("_raw")), STATEMENTS)).drop("_prompt", "_raw")


def verify_statements(extracted: DataFrame, model: StatementVerifier, max_items: int = 128) -> DataFrame:
    """``extracted`` with ``cleaned``: the verifier's statements object."""
    payload = coerce_payload(F.to_json(F.slice("statements", 1, max_items)))
    asked = extracted.withColumn("_prompt", F.concat(F.lit("Input JSON:\n"), payload, F.lit("\nOutput:")))
    from explainkit.functions.json_text import first_statements

    found = generate_column(asked, "_prompt", "_raw", model)
    return found.withColumn("cleaned", F.from_json(first_statements(F.col("_raw")), f"struct<statements:{STATEMENTS}>")).drop("_prompt", "_raw")


def judge_texts(df: DataFrame, text: str, model: StatementExtractor, retries: int = 2) -> DataFrame:
    """``df`` with ``verdict``: each distinct text is judged once, unreadable answers are asked again."""

    class Patient:
        def generate(self, prompts: list[str]) -> list[str]:
            found = model.generate(prompts)
            for _ in range(retries):
                bad = [i for i, f in enumerate(found) if not re.search(r'"atomicity"\s*:\s*"?[01]', f or "")]
                if not bad:
                    break
                for i, f in zip(bad, model.generate([prompts[i] for i in bad]), strict=True):
                    found[i] = f
            return found

    from explainkit.functions.text import is_missing, strip

    once = df.where(~is_missing(F.col(text))).select(strip(F.col(text)).alias("_text")).distinct()
    judged = generate_column(once, "_text", "_raw", Patient()).select("_text", verdict(F.col("_raw")).alias("verdict"))
    return df.join(judged, strip(F.col(text)) == F.col("_text"), "left").drop("_text")


def encode_column(df: DataFrame, text: str, model: TextEncoder, out: str = "embedding") -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model.encode(s.fillna("").tolist())), index=s.index)

    return df.withColumn(out, run(text))


def score_pairs(df: DataFrame, a: str, b: str, model: PairScorer, out: str = "cross_encoder_sim") -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(zip(x, y, strict=True))), index=x.index)

    return df.withColumn(out, run(a, b))
