"""Confusion counts and the ratios made of them. Ratios are not rounded: engines round ties differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detect_metrics(df: DataFrame, truth: Column, predicted: Column, true_cwe: Column, own_cwe: Column, *by: str) -> DataFrame:
    """Counts, recall, precision, F1, accuracy (0 if undefined) and CWE accuracy (null if undefined).

    Null truth and null prediction count as false. CWE accuracy looks at true positives whose truth names a CWE, and
    asks whether the predicted one begins with it.
    """
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    named = t & p & (F.coalesce(true_cwe, F.lit("")) != "")
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(named).alias("cwe_total"), F.count_if(named & F.coalesce(own_cwe, F.lit("")).startswith(true_cwe)).alias("cwe_hits"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "n", "tp", "fp", "fn", "tn", "cwe_total", "cwe_hits",
        _ratio(tp, tp + fn).alias("recall"), _ratio(tp, tp + fp).alias("precision"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, F.col("n")).alias("accuracy"),
        F.try_divide(F.col("cwe_hits").cast("double"), F.col("cwe_total").cast("double")).alias("cwe_accuracy"),
    )


def triage_metrics(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """Confirm recall, false positive rate and accuracy. Truth other than ``Confirm``, null too, counts as reject."""
    t = F.coalesce(truth == "Confirm", F.lit(False))
    p = F.coalesce(F.lower(predicted) == "confirm", F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(t).alias("gt_confirm"), F.count_if(~t).alias("gt_reject"), F.count_if(t & p).alias("kept_true"), F.count_if(~t & p).alias("kept_false"), F.count_if(~t & ~p).alias("dropped_false")
    )
    c = F.col
    return counts.select(
        *by, "n", "gt_confirm", "gt_reject", "kept_true", "kept_false", "dropped_false",
        _ratio(c("kept_true"), c("gt_confirm")).alias("confirm_recall"), _ratio(c("kept_false"), c("gt_reject")).alias("fpr"), _ratio(c("kept_true") + c("dropped_false"), c("n")).alias("accuracy"),
    )


def probe_summary(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Accuracy, recall and false positive rate of probes; null, not 0, where undefined."""
    verdict = F.when(F.lower(predicted).contains("confirm"), "Confirm").when(F.lower(predicted).contains("reject"), "Reject").otherwise("?")
    rows = df.select(truth.alias("t"), verdict.alias("p"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("p")).alias("right"), F.count_if(F.col("t") == "Confirm").alias("confirms"), F.count_if((F.col("t") == "Confirm") & (F.col("p") == "Confirm")).alias("hits"), F.count_if(F.col("t") == "Reject").alias("rejects"), F.count_if((F.col("t") == "Reject") & (F.col("p") == "Confirm")).alias("false_hits"))
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return counts.select("n", "right", "hits", "false_hits", part("right", "n").alias("accuracy"), part("hits", "confirms").alias("recall"), part("false_hits", "rejects").alias("fpr"))


def metric_delta(before: DataFrame, after: DataFrame, key: str, *metrics: str) -> DataFrame:
    """The change of each metric between two runs, by key."""
    a = before.select(key, *(F.col(m).alias(f"{m}_before") for m in metrics))
    b = after.select(key, *(F.col(m).alias(f"{m}_after") for m in metrics))
    return a.join(b, key).select(key, *(c for m in metrics for c in (f"{m}_before", f"{m}_after", (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta"))))


def timing_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, least, greatest and sample deviation (null for one value)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"))


def mismatches(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """The rows whose prediction is not the truth; null is like no other value."""
    return df.where(~truth.eqNullSafe(predicted))
