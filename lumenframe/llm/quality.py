"""Operator 7: quality rules whose cutoffs are risk-controlled on labelled holdouts.

Measures of every text give rules ("the share of repeated words is over c"). For each stratum (the text's ``lang``) and
rule, cutoffs of a fixed grid are tested on the labelled documents of good quality that pass the base rules: the exact
(Clopper-Pearson) upper bound of a cutoff's false rejection rate, at a confidence corrected for all tests of all
strata, rules and cutoffs (Bonferroni), must not exceed ALPHA divided by the number of rules, so that all rules of a
stratum together reject at most ALPHA of its good documents, with probability 1 - DELTA for all strata at once. The
strictest such cutoff is used; a stratum without evidence rejects nothing by that rule. All labelled rows and all strata
are used, as a table of counts, a row each; the cutoffs are a table too, joined to the documents by stratum.

Null texts have no words and fail the base rules, as do empty ones. Null or unseen strata have no cutoffs. Labels with
null ids or values, and labels of unknown documents, are not used; repeated labels of one document count as one (good
only if all are). Cutoffs at which the bound ties with the limit count as safe. Repeated rows give repeated rows; an empty
table gives none, empty labels give no cutoffs. A very long text is a block of its own. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import map_texts, materialize, quoted, read

ALPHA = 0.02
DELTA = 0.05
#: (name, numerator, denominator, cutoffs from strict to loose): a rule rejects where numerator > cutoff * denominator.
RULES = (
    ("repeats", "n_repeat_words", "n_words", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    ("symbols", "n_symbols", "word_chars", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)),
    ("dup_lines", "n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    ("long_words", "word_chars", "n_words", (8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0)),
)
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, ...]:
    """In the order of MEASURES; lines are counted if they have a word."""
    if not text:
        return (0,) * 6
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    n = len(words)
    # a window found twice or more marks its three words
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        count, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat, len(lines)


def measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def block(texts):
        rows = list(map(measure, texts))
        return dict(zip(names, zip(*rows))) if rows else {k: [] for k in names}

    return map_texts(df, text, block, MEASURES, keep)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction, in about the square root of a + b steps."""
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side only
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            return out


def upper_bound(bad: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate p at which at most ``bad`` of ``n`` have probability ``delta``."""
    if not n or bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta(n - bad, bad + 1, 1 - mid) > delta else (low, mid)
    return high


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rejects(numerator: str, denominator: str, cutoff):
    return F.col(numerator) > cutoff * F.col(denominator)


def cutoff_table(measured: DataFrame, labels: DataFrame, *, id_col: str, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff for each rule, null where none is safe), a row for every stratum with evidence, from counts over all labelled good documents.

    Bounds are worked out where the counts are; only the number of strata, which the correction needs, is collected.
    """
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1")
    held = measured.where(~base_failed() & F.col(stratum).isNotNull()).join(good.select(id_col), id_col, "left_semi")
    counts = [F.count(F.lit(1)).alias("n")]
    counts += [F.count_if(_rejects(num, den, c)).alias(f"{name}_{i}") for name, num, den, grid in RULES for i, c in enumerate(grid)]
    counted = materialize(held.groupBy(F.col(stratum).alias("stratum")).agg(*counts), "counts")
    confidence = delta / (max(1, counted.count()) * sum(len(r[3]) for r in RULES))
    most = alpha / len(RULES)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            columns = [batch.column("stratum")]
            for name, _, _, grid in RULES:
                # a cutoff whose observed rate is over the limit already needs no bound
                safe = [[c for i, c in enumerate(grid) if r[f"{name}_{i}"] <= most * r["n"] and upper_bound(r[f"{name}_{i}"], r["n"], confidence) <= most] for r in rows]
                columns.append(pa.array([min(ok, default=None) for ok in safe], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=["stratum", *(r[0] for r in RULES)])

    kind = T.StructType([T.StructField("stratum", counted.schema["stratum"].dataType), *[T.StructField(r[0], T.DoubleType()) for r in RULES]])
    return materialize(counted.mapInArrow(run, kind), "cutoffs")


def select_cutoffs(measured: DataFrame, labels: DataFrame, **options) -> dict[str, dict[str, float]]:
    """The table of cutoffs as a dictionary by stratum and rule, to be looked at."""
    rows = cutoff_table(measured, labels, **options).collect()
    return {r["stratum"]: {k: v for k, v in r.asDict().items() if k != "stratum" and v is not None} for r in rows}


def apply_rules(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, n_words, the base measures, base_failed, kept, and the rules that reject (comma-joined)."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(stratum)).alias("stratum"), F.col(quoted(text)).alias("text"))
    measured = materialize(measures(rows, ["id", "stratum"]), "measures")
    found = labels.select(F.col(quoted(id_col)).alias("id"), "quality")
    cutoffs = cutoff_table(measured, found, id_col="id", stratum="stratum", alpha=alpha, delta=delta)
    judged = measured.join(cutoffs, "stratum", "left")
    rejected = F.concat_ws(",", *[F.when(_rejects(num, den, F.col(name)), F.lit(name)) for name, num, den, _ in RULES])
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (rejected == "")).alias("kept"), rejected.alias("rejected_by"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
