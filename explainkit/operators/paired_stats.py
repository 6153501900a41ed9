"""Paired comparison of two methods' metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from explainkit.operators.dictionary import running_totals
from explainkit.plans.storage import persist_table


def paired(a: DataFrame, b: DataFrame, key: list[str], metric: str) -> DataFrame:
    """``(key..., a, b, diff)`` of the samples that both methods have."""
    left, right = a.select(*key, F.col(metric).alias("a")), b.select(*key, F.col(metric).alias("b"))
    return left.join(right, key).where("a is not null and b is not null and not isnan(a) and not isnan(b)").withColumn("diff", F.col("a") - F.col("b"))


def paired_stats(pairs: DataFrame, min_pairs: int = 5) -> DataFrame:
    """One row: n, means, mean and median difference, Cohen's d (sample deviation), Cliff's delta, t.

    NaN below ``min_pairs`` pairs; d and t are NaN where the differences don't vary.
    """
    d = F.col("diff")
    pairs = persist_table(pairs.select("a", "b", "diff"), "paired")  # read twice: by the sums and by the median
    raw = pairs.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"), F.avg(F.signum(d)).alias("cliffs_delta"))
    raw = raw.join(exact_median(pairs, "diff"), F.lit(True), "left")  # two single rows
    nan = F.lit(float("nan"))
    enough = F.col("n") >= min_pairs
    varied = enough & (F.col("_sd") > 0)
    keep = lambda c: F.when(enough, F.col(c)).otherwise(nan).alias(c)
    cohen = F.when(varied, F.col("mean_diff") / F.col("_sd")).otherwise(nan)
    return raw.select("n", keep("mean_a"), keep("mean_b"), keep("mean_diff"), keep("median_diff"), cohen.alias("cohen_d"), keep("cliffs_delta"), (cohen * F.sqrt("n")).alias("t"))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median_<column>``, from counts of distinct values running over ranges of them: no task holds all values."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    ranked = running_totals(values, ["x"], upto="c")
    total = ranked.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n"))
    both = ranked.join(total, F.lit(True))  # a single row
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda at: F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at), F.col("x")))
    return both.agg(((holds(low) + holds(high)) / 2).alias(f"median_{column}"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """One row ``(n, w, z, p)``: signed ranks of the non-zero differences, ties averaged, with the tie-corrected normal
    statistic and its two-sided p-value (1 where nothing differs).

    Ranks come from counts of distinct absolute differences, not from a sort of all rows in one task.
    """
    rows = pairs.where("diff <> 0").select(F.round(F.abs("diff"), 12).alias("m"), (F.col("diff") > 0).alias("up"))
    by_size = rows.groupBy("m").agg(F.count("*").alias("c"), F.count_if("up").alias("ups"))
    ranked = running_totals(by_size, ["m"], upto="c").withColumn("rank", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2.0)
    c = F.col("c").cast("double")
    total = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("ups")), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(c * c * c - c), F.lit(0.0)).alias("ties"))
    n = F.col("n").cast("double")
    other = n * (n + 1) / 2 - F.col("plus")
    w = F.least(F.col("plus"), other)
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (w - n * (n + 1) / 4) / spread).otherwise(0.0)
    return total.select("n", w.alias("w"), z.alias("z"), F.when(n == 0, 1.0).otherwise(normal_p(z)).alias("p"))


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic from ``n`` pairs (incomplete beta by continued fraction)."""
    return pd.Series([student_p(a, int(b) - 1) for a, b in zip(t, n, strict=True)])


def student_p(t: float, df: int) -> float:
    if math.isnan(t) or df < 1:
        return float("nan")
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (max(abs(1 + step * d), 1e-30) * (1 if 1 + step * d >= 0 else -1))
        c = 1 + step / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal statistic (rational approximation of erfc, error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        poly = F.lit(k) + t * poly
    return t * F.exp(-x * x + poly)


def significance_label(p: Column, thresholds: tuple[float, ...] = (0.05, 0.01, 0.001)) -> Column:
    """The smallest threshold that ``p`` is below, ``ns`` for none, ``na`` without a value."""
    out = F.lit("ns")
    for t in sorted(thresholds, reverse=True):
        out = F.when(p < t, f"p<{t:g}").otherwise(out)
    return F.when(p.isNull() | F.isnan(p), "na").otherwise(out)
