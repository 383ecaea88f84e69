"""Acceptance gates, host-window threshold analysis, and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import metrics, windows


def acceptance(per_class: DataFrame, needs: list[tuple[str, int, float, float]]) -> DataFrame:
    """For each label that has needs (label, support, recall, f1): what it has, and whether that is enough; labels without a row have 0."""
    rows = per_class.sparkSession.createDataFrame(needs, "label string, min_support int, min_recall double, min_f1 double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    found = rows.join(per_class.select("label", "support", "recall", "f1"), "label", "left").select("label", "min_support", "min_recall", "min_f1", zero("support"), zero("recall"), zero("f1"))
    enough = F.col("support") >= F.col("min_support")
    return found.withColumns({"passed": enough & (F.col("recall") >= F.col("min_recall")) & (F.col("f1") >= F.col("min_f1")), "reason": F.when(~enough, "support").when(F.col("recall") < F.col("min_recall"), "recall").when(F.col("f1") < F.col("min_f1"), "f1")})


def truncation_warnings(by_label: DataFrame, labels: list[str], least_rows: int, most: float = 0.25, label: str = "major_label") -> DataFrame:
    """Rows of audit.truncation() of watched labels with enough rows and too large a share."""
    return by_label.where(F.col(label).isin(labels) & (F.col("rows") >= least_rows) & (F.col("ratio") > most))


def epoch_warnings(history: DataFrame, score: str = "val_macro_f1", epoch: str = "epoch", most: float = 0.05) -> DataFrame:
    """One row: best and last score of a training history, and whether the last falls behind by more than most."""
    ends = history.agg(F.max(score).alias("best"), F.max_by(score, epoch).alias("last"))
    return ends.withColumn("late_drop", F.col("best") - F.col("last") > most)


def any_low(df: DataFrame, label: str, watched: list[str], least: int, splits: tuple[str, ...] = ("val", "test")) -> bool:
    from millrace.operators.audit import low_support

    return not low_support(df, label, watched, least, splits).isEmpty()


def schema_gate(df: DataFrame, schema: dict[str, str], constants: dict[str, str]) -> list[str]:
    """What is wrong with a table: missing columns, other types, other values than the constant ones. Reads the schema, and one aggregate."""
    types = dict(df.dtypes)
    wrong = [f"{c}: missing" for c in schema if c not in types] + [f"{c}: {types[c]}, not {t}" for c, t in schema.items() if c in types and types[c] != t]
    known = {c: v for c, v in constants.items() if c in types}
    if known:
        n = df.agg(*[F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in known.items()]).first()
        wrong += [f"{c}: {n[c]} rows are not {v}" for c, v in known.items() if n[c]]
    return wrong


def applied(df: DataFrame, score: str, target: Column, threshold: DataFrame) -> DataFrame:
    """Counts and rates of score >= the one threshold of another table."""
    return metrics.threshold_sweep(df, score, target, threshold.select("threshold"))


def host_thresholds(val: DataFrame, test: DataFrame, target: str, seconds: list[int], min_recall: float, min_f1: float, keys: tuple[str, ...] = ("source_file", "host"), steps: int = 999, quantiles: int = 301) -> DataFrame:
    """Thresholds chosen on val and applied to test: of flows' scores, of trailing maxima and of windows' maxima for each length.

    Columns kind (flow, trailing, bucket), window_seconds, split, and those of a threshold's row.
    """
    keys_ = list(keys)
    hit = F.col("major_label") == target
    tables = {"val": val.withColumn("is_target", hit), "test": test.withColumn("is_target", hit)}
    views = [("flow", 0, {n: t.select("score", "is_target") for n, t in tables.items()})]
    for s in seconds:
        views.append(("trailing", s, {n: t.select(windows.trailing_max("score", keys_, "start_us", "flow_id", s).alias("score"), "is_target") for n, t in tables.items()}))
        views.append(("bucket", s, {n: windows.score_buckets(t, keys_, "start_time", "score", "is_target", s).select(F.col("max_score").alias("score"), F.col("has_target").alias("is_target")) for n, t in tables.items()}))
    out = None
    for kind, s, pair in views:
        grid = metrics.candidate_thresholds(pair["val"], "score", steps, quantiles)
        best = metrics.best_threshold(metrics.threshold_sweep(pair["val"], "score", F.col("is_target"), grid), min_recall, min_f1)
        # One number decides the rest of the report.
        chosen = best.first()["threshold"]
        one = val.sparkSession.createDataFrame([(chosen,)], "threshold double")
        for name, t in pair.items():
            row = applied(t, "score", F.col("is_target"), one).select(F.lit(kind).alias("kind"), F.lit(s).alias("window_seconds"), F.lit(name).alias("split"), "*")
            out = row if out is None else out.unionAll(row)
    return out


def policies_of(report: DataFrame, target: str, min_recall: float, min_f1: float) -> list[tuple[str, int, float]]:
    """Policies (target, seconds, threshold) of host_thresholds(): windows whose test figures reach the minima, in order of their length as text."""
    rows = report.where((F.col("kind") == "bucket") & (F.col("split") == "test") & (F.col("recall") >= min_recall) & (F.col("f1") >= min_f1)).select("window_seconds", "threshold").collect()
    return [(target, r["window_seconds"], r["threshold"]) for r in sorted(rows, key=lambda r: str(r["window_seconds"]))]


def enabled_policies(payload: dict) -> list[dict]:
    """The enabled policies of a policy file; without a flag, those whose test passed."""
    return [dict(p) for p in payload.get("policies", []) if p.get("enabled", p.get("test_passed_requirements", True))]


def target_probability(label: Column, prob: Column, probs: Column, target: str) -> Column:
    """The target's probability in a map, else that of the prediction if it is the target, else 0."""
    return F.coalesce(F.try_element_at(probs, F.lit(target)), F.when(label == target, prob), F.lit(0.0))
