"""Quality rules whose cutoffs adapt to each language and source.

Each document gets exact counts; four ratios of them feed mergeable quantile sketches with logarithmic
buckets (1 % relative error), one per language and source. A sketch is a table of bucket counts, so
merging is addition: partial sums are formed before any shuffle, a hot source costs no more than a rare
one, and the result doesn't depend on order. A sketch's cutoff is its median plus some times its lower
spread. A group's cutoff is drawn towards that of its language, and a language's towards that of all, as if
``PRIOR`` documents of the wider sketch belonged to the narrower one; so small groups lean on wider ones,
large ones on themselves, without a jump. Joining the cutoffs back gives the verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from explainkit.llm.common import SLICE, map_batches, own_columns
from explainkit.plans.storage import persist_table

#: Fixed values of the contract: white space between words, and the symbols counted.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Least spread of each ratio (as parts of one); a cutoff is the median + REACH * max(spread, lower half's spread).
RATIOS = {"symbol_ratio": 0.01, "upper_ratio": 0.012, "dup_line_ratio": 0.06, "repeat_ratio": 0.05}
REACH, PRIOR = 6.0, 200
GAMMA, SMALLEST = 1.02, 1e-4


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in ``STATS``; null counts as no text."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines), upper_letters(text)


def upper_letters(text: str) -> int:
    """Characters that change in lower case."""
    low = text.lower()
    if len(low) != len(text):  # some character's lower case is longer, so each is asked for itself
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (text, low))
    return int((a != b).sum())


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    size = len(ids)
    pair = seq[:-1] * size + seq[1:]
    if size > 1_000_000:  # keep the triple within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * size + seq[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(triple), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for shift in range(3):
        cover[shift : shift + len(twice)] |= twice
    return int(cover.sum())


def with_stats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the counts of ``text`` appended under ``prefix``; all columns pass through as they are."""
    names = [prefix + s for s in STATS]
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = list(zip(*map(text_stats, part.column(at).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(r, pa.int64()) for r in rows)], names=[*part.schema.names, *names])

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return map_batches(docs, run, schema)


def _ratios(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": share(c("n_symbols"), c("word_chars")),
        "upper_ratio": share(c("n_upper"), c("word_chars")),
        "dup_line_ratio": share(c("n_dup_lines"), c("n_lines")),
        "repeat_ratio": share(c("n_repeat_words"), c("n_words")),
    }


def sketches(stats: DataFrame, prefix: str = "") -> DataFrame:
    """Bucket counts ``(level, lang, source, ratio, bucket, n)`` per language and source, per language, and over all."""
    step = math.log(GAMMA)
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("x")) for k, v in _ratios(prefix).items()])).alias("m")
    rows = stats.select("lang", "source", found).select("lang", "source", "m.*")
    bucket = F.when(F.col("x") < SMALLEST, F.lit(None).cast("int")).otherwise(F.ceil(F.log("x") / step).cast("int"))
    fine = rows.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    level = lambda df, n: df.withColumn("level", F.lit(n))
    by_lang = fine.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string"))
    overall = by_lang.groupBy("ratio", "bucket").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    return level(fine, 0).unionByName(level(by_lang, 1)).unionByName(level(overall, 2))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """``(level, lang, source, docs, <ratio>_cut...)`` from the sketches' quartiles."""
    keys = ["level", "lang", "source", "ratio"]
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    upto = W.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(W.partitionBy(*keys))).withColumn("x", value)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("x")))
    spread = F.create_map(*[y for k, v in RATIOS.items() for y in (F.lit(k), F.lit(v))])[F.col("ratio")]
    cut = F.col("mid") + REACH * F.greatest(F.col("mid") - F.col("low"), spread)
    flat = ranked.groupBy(*keys).agg(at(0.25).alias("low"), at(0.5).alias("mid"), F.max("docs").alias("docs")).withColumn("cut", cut)
    return flat.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("ratio") == k, F.col("cut"))).alias(f"{k}_cut") for k in RATIOS])


def group_cutoffs(sketch: DataFrame) -> DataFrame:
    """The cutoffs that hold for each language and source, drawn towards those of the wider groups."""
    cuts = [f"{k}_cut" for k in RATIOS]
    found = cutoffs(sketch)
    pick = lambda n, tag: found.where(F.col("level") == n).select("lang", "source", F.col("docs").alias(f"docs{tag}"), *[F.col(c).alias(f"{c}{tag}") for c in cuts])
    fine, lang, world = pick(0, 0), pick(1, 1).drop("source").withColumnRenamed("lang", "lang1"), pick(2, 2).drop("lang", "source")
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(world, F.lit(True), "left")
    drawn = lambda n, own, wider: (n * own + PRIOR * wider) / (n + PRIOR)
    cut = lambda c: drawn(F.col("docs0"), F.col(f"{c}0"), drawn(F.col("docs1"), F.col(f"{c}1"), F.col(f"{c}2")))
    return joined.select(F.col("lang").alias("cut_lang"), F.col("source").alias("cut_source"), *[cut(c).alias(c) for c in cuts])


def judge(stats: DataFrame, cuts: DataFrame, prefix: str = "") -> DataFrame:
    """``stats`` with ``<prefix>base_failed`` and ``<prefix>kept``; no column of ``stats`` but the counts starts with a ``prefix``."""
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    cuts = cuts.toDF(*[prefix + c for c in cuts.columns])
    within = F.lit(True)
    for name, ratio in _ratios(prefix).items():
        within = within & (F.round(ratio, 12) <= F.round(f"{prefix}{name}_cut", 12))
    joined = stats.join(cuts, F.col("lang").cast("string").eqNullSafe(F.col(prefix + "cut_lang")) & F.col("source").cast("string").eqNullSafe(F.col(prefix + "cut_source")), "left")
    kept = ~failed & F.coalesce(within, F.lit(False))
    return joined.select(*own_columns(stats), failed.alias(prefix + "base_failed"), kept.alias(prefix + "kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document.

    Null, empty or wordless text counts as no words and fails the base rule; very long texts are counted whole;
    null languages or sources form groups of their own; a ratio equal to its cutoff is kept; each row is
    answered and counted in the sketches, repeated rows and null ids too; extra columns don't matter; an empty
    table gives no rows.
    """
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    stats = persist_table(with_stats(need).drop("text"), "quality")
    out = judge(stats, group_cutoffs(sketches(stats)))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "n_lines", "n_upper")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The counts are taken twice, so that no text is shuffled.

    Odd rows count as in :func:`quality_verdicts`: null, empty and wordless texts go, repeated rows and null ids
    are judged one by one. Columns of any name pass through; an empty table gives no rows.
    """
    mark = "_quality_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    need = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    cuts = group_cutoffs(persist_table(sketches(with_stats(need).drop("text")), "sketches"))
    return judge(with_stats(docs, mark), cuts, mark).where(F.col(mark + "kept")).select(*own_columns(docs))
