"""Calibration, agreement, detection and paired metrics, as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.graph import stored

BINS = 10
CLAMP = 1e-6
STEPS, RATE = 2000, 0.1
#: Distinct (margin, outcome) counts that the driver holds at most: 24 bytes each.
HELD = 1 << 20


def calibration_bins(df: DataFrame, conf: str = "conf", outcome: str = "outcome") -> DataFrame:
    """Per bin (low, high] of confidence (the first closed): rows, sums of confidence and outcome."""
    b = F.greatest(F.lit(1), F.ceil(F.col(conf) * BINS)).cast("int").alias("bin")
    return df.where(F.col(conf).isNotNull() & F.col(outcome).isNotNull()).groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("sum_conf"), F.sum(outcome).alias("hits"))


def expected_calibration_error(df: DataFrame, **columns) -> DataFrame:
    gap = F.abs(F.col("sum_conf") / F.col("n") - F.col("hits") / F.col("n")) * F.col("n")
    return calibration_bins(df, **columns).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def clamped(conf) -> Column:
    return F.least(F.greatest(F.col(conf), F.lit(CLAMP)), F.lit(1 - CLAMP))


def brier(conf: str, outcome: str) -> Column:
    return F.avg(F.pow(clamped(conf) - F.col(outcome), 2))


def log_loss(conf: str, outcome: str, temperature: Column | float = 1.0) -> Column:
    """Sum of the tempered negative log-likelihood."""
    p = clamped(conf)
    z = F.log(p / (1 - p)) / temperature
    return F.sum(F.log1p(F.exp(F.when(F.col(outcome) == 1, -z).otherwise(z))))


def fit_temperature(df: DataFrame, conf: str = "conf", outcome: str = "outcome", rounds: int = 6, points: int = 41) -> float:
    """Temperature of least log-loss by refining a grid; 1 with under 30 rows or a single class.

    Rows are first counted by (confidence, outcome); every round is one aggregate with all temperatures as columns.
    """
    counted = stored(df.groupBy(conf, outcome).agg(F.count(F.lit(1)).alias("__n")), "confidences")
    n, hits = counted.agg(F.sum("__n"), F.sum(F.col("__n") * F.col(outcome))).first()
    if not n or n < 30 or hits in (0, n):
        return 1.0
    low, high, best = 0.25, 4.0, 1.0
    p = clamped(conf)
    z = F.log(p / (1 - p))
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        losses = counted.agg(*[F.sum(F.col("__n") * F.log1p(F.exp(F.when(F.col(outcome) == 1, -z / t).otherwise(z / t)))).alias(str(i)) for i, t in enumerate(grid)]).first()
        i = min(range(points), key=lambda k: (losses[k], k))
        best, low, high = grid[i], grid[max(0, i - 1)], grid[min(points - 1, i + 1)]
    return best


def fit_margin(df: DataFrame, margin: str = "margin", outcome: str = "outcome") -> DataFrame:
    """One row: slope and intercept of the logistic curve of margins (eight places), the numbers of samples and positives, and whether it was fitted.

    STEPS steps of full gradient descent from (1, 0). Rows are counted by (margin, outcome) first. HELD such counts are
    summed on the driver at most; more are summed by an aggregate a step over the stored counts, with the same result but
    for the order of the sums. Under 30 rows, or with a single outcome, (1, 0) stays. Rows with a null count for nothing.
    """
    counted = stored(df.where(F.col(margin).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(margin).cast("double").alias("m"), F.col(outcome).cast("int").alias("o")).agg(F.count(F.lit(1)).alias("n")), "margins")
    n, hits, held = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("o")), F.count(F.lit(1))).first()
    n, hits = n or 0, hits or 0
    slope, intercept, fitted = 1.0, 0.0, n >= 30 and 0 < hits < n
    if fitted:
        rows = counted.orderBy("m", "o").toPandas() if held <= HELD else None
        for _ in range(STEPS):
            if rows is not None:
                error = rows["n"] * (1 / (1 + np.exp(-(slope * rows["m"] + intercept))) - rows["o"])
                steep, level = (error * rows["m"]).sum(), error.sum()
            else:
                error = F.col("n") * (1 / (1 + F.exp(-(slope * F.col("m") + intercept))) - F.col("o"))
                steep, level = counted.agg(F.sum(error * F.col("m")), F.sum(error)).first()
            slope, intercept = slope - RATE * float(steep) / n, intercept - RATE * float(level) / n
    return df.sparkSession.createDataFrame([(round(slope, 8), round(intercept, 8), n, hits, fitted)], "slope double, intercept double, samples long, positives long, fitted boolean")


def precision_threshold(df: DataFrame, conf: str = "conf", outcome: str = "outcome", least_rows: int = 5, target: float = 0.98) -> DataFrame:
    """The smallest confidence from which on precision reaches the target, over at least ``least_rows`` rows.

    Rows are counted by confidence first. Running sums go bin by bin of 1/1024: those of whole bins over the bins (a table
    of 1025 rows), those inside a bin in a task of its own.
    """
    by = df.where(F.col(conf).isNotNull()).groupBy(F.col(conf).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("k"))
    by = stored(by.withColumn("bin", F.floor(F.least(F.greatest(F.col("threshold"), F.lit(0.0)), F.lit(1.0)) * 1024)), "confidences")
    bins = by.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("k").alias("bk"))
    over = Window.orderBy(F.desc("bin"))
    above = bins.select("bin", (F.sum("bn").over(over) - F.col("bn")).alias("before_n"), (F.sum("bk").over(over) - F.col("bk")).alias("before_k"))
    inside = Window.partitionBy("bin").orderBy(F.desc("threshold"))
    run = by.withColumns({"in_n": F.sum("n").over(inside), "in_k": F.sum("k").over(inside)}).join(F.broadcast(above), "bin")
    run = run.withColumns({"accepted": F.col("before_n") + F.col("in_n"), "correct": F.col("before_k") + F.col("in_k")})
    ok = run.where((F.col("accepted") >= least_rows) & (F.col("correct") >= F.lit(target) * F.col("accepted")))
    return ok.agg(F.min("threshold").alias("threshold"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("ra")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, "v").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("chance"))
    total = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", "same", F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def precision_recall(tp, fp, fn) -> list[Column]:
    """precision, recall and F1 of counts, 0 on empty denominators."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def threshold_sweep(df: DataFrame, score: str, outcome: str, steps: int = 20) -> DataFrame:
    """tp, fp, fn and their metrics for thresholds 0, 1/steps, ...; a row counts once, then thresholds run over the counts."""
    step = F.least(F.floor(F.col(score) * steps), F.lit(steps - 1)).cast("int")
    by = df.where(F.col(score).isNotNull()).groupBy(step.alias("s")).agg(F.sum(outcome).alias("k"), F.count(F.lit(1)).alias("n"))
    spread = by.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    above = F.col("s") >= F.col("step")
    out = spread.groupBy("step").agg(F.sum(F.when(above, F.col("k")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("n") - F.col("k")).otherwise(0)).alias("fp"), F.sum(F.when(above, 0).otherwise(F.col("k"))).alias("fn"))
    return out.select("step", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def strata_recall(df: DataFrame, stratum: str, found: str, expected: str, least: int = 30) -> DataFrame:
    """Recall by stratum and in all (null stratum, ``is_total``), with whether the evidence suffices."""
    n = F.sum(expected)
    return df.rollup(stratum).agg(F.grouping(stratum).cast("int").alias("is_total"), F.sum(found).alias("found"), n.alias("expected"), F.when(n > 0, F.sum(found) / n).alias("recall"), (n >= least).alias("sufficient"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Exact two-sided binomial p of discordant pairs; both counts are aggregates, p is computed from them."""
    counts = pairs.agg(F.coalesce(F.sum(F.when(F.col(a) & ~F.col(b), 1)), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when(~F.col(a) & F.col(b), 1)), F.lit(0)).alias("only_b"))

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([binomial_p(int(min(a, b)), int(a + b)) for a, b in zip(x, y)])

    return counts.withColumn("p", exact("only_a", "only_b"))


def binomial_p(k: int, n: int) -> float:
    """Sum of the probabilities of outcomes not likelier than k of n at one half: twice a tail, by the incomplete beta function."""
    k = min(k, n - k)
    return 1.0 if 2 * k >= n else min(1.0, 2 * _half_beta(n - k, k + 1))


def _half_beta(a: int, b: int) -> float:
    """The incomplete beta function at one half for a over b, by its continued fraction: steps grow with the square root of a + b."""
    x, tiny = 0.5, 1e-300
    if x > (a + 1) / (a + b + 2):
        return 1 - _half_beta(b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            return front * out


def bootstrap_mean(df: DataFrame, value: str, key: str, rounds: int = 2000, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean by a Poisson bootstrap: hashes of key and round give each row's weight, so that no rows are moved.

    A task adds up weights and weighted values of all rounds in two arrays; its sums alone are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))

    def run(batches):
        total, weighted = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for b in range(rounds):
                x = h + np.uint64((b + 1) * 0x9E3779B97F4A7C15 % 2**64)  # the mixing steps of a splitmix generator
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cuts, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53)
                total[b] += w.sum()
                weighted[b] += w @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(total), pa.array(weighted)], names=["b", "w", "s"])

    means = rows.mapInArrow(run, "b int, w double, s double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def concordance(df: DataFrame, key: str, item: str, a: str, b: str) -> DataFrame:
    """How many pairs of a group differ by ``a``, and of how many of them ``b`` keeps the order.

    A group's rows come sorted by ``a``; one pass keeps the values of ``b`` seen so far sorted, so that no pair is formed.
    """
    from bisect import bisect_left, insort

    from pyspark.sql import types as T

    from lumenframe.operators.spatial import each_asset

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    out = T.StructType([*rows.schema, T.StructField("n_pairs", T.LongType()), T.StructField("n_kept", T.LongType())])

    def run(xs, ys):
        seen, wait, last, pairs, kept = [], [], None, 0, 0
        for x, y in zip(xs, ys):
            if x != last:
                for v in wait:
                    insort(seen, v)
                wait, last = [], x
            pairs += len(seen)
            kept += bisect_left(seen, y)
            wait.append(y)
        return ([0], [[pairs], [kept]]) if pairs else ([], [[], []])

    return each_asset(rows, key, [a, b], run, out, (F.asc(a),)).select(key, "n_pairs", "n_kept")


def area_vote(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The label with the largest sum of areas (1 at least each), the first in order of equals."""
    votes = df.groupBy(*by, label).agg(F.sum(F.greatest(F.lit(1), F.col("w") * F.col("h"))).alias("area"))
    order = Window.partitionBy(*by).orderBy(F.desc("area"), F.asc(label))
    return votes.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
