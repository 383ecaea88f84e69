"""Classification metrics, thresholds and calibration as small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def grid(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each label of a list, with its place."""
    return df.sparkSession.createDataFrame(list(enumerate(labels)), "id int, label string")


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """Row for each pair of labels: count, and share of the true label's row (0 for a row of zeros)."""
    counts = df.groupBy(F.col(truth).alias("true_label"), F.col(guess).alias("pred_label")).agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, labels))
    pairs = df.sparkSession.range(1).select(F.explode(names).alias("true_label")).select("true_label", F.explode(names).alias("pred_label"))
    full = pairs.join(counts, ["true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("true_label")), F.lit(1)))


def per_class(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """Per label: support, predicted, tp, precision, recall, f1."""
    both = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    ends = both.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    sums = ends.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = grid(df, labels).select("label").join(sums, "label", "left").select("label", zero("support"), zero("predicted"), zero("tp"))
    out = full.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def major_metrics(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """One row: accuracy; macro means over labels in truth or prediction, and over all labels; weighted means; balanced accuracy."""
    c = per_class(df, truth, guess, labels)
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    total = F.sum("support")
    exprs = [ratio(F.sum("tp"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        exprs += [
            F.coalesce(F.avg(F.when(present, F.col(m))), F.lit(0.0)).alias(f"macro_{m}"), F.avg(m).alias(f"all_config_macro_{m}"), ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}"),
        ]
    exprs.append(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"))
    return c.agg(*exprs)


def detection(df: DataFrame, truth: str, guess: str, benign: str = "benign") -> DataFrame:
    """One row of benign against all others: counts, precision, recall, f1, rates, accuracy."""
    t, g = F.col(truth) != benign, F.col(guess) != benign
    n = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    out = n.withColumns({"attack_precision": ratio(tp, tp + fp), "attack_recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "tnr": ratio(tn, tn + fp), "binary_accuracy": (tp + tn) / F.greatest(tp + tn + fp + fn, F.lit(1))})
    return out.withColumn("attack_f1", f1_of(F.col("attack_precision"), F.col("attack_recall")))


def binary(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: counts, precision, recall, f1 with the small floors that threshold scans use."""
    n = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    return with_rates(n)


def with_rates(n: DataFrame) -> DataFrame:
    out = n.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def multilabel(df: DataFrame, truth: str, probs: str, names: list[str], threshold: float = 0.5) -> DataFrame:
    """Per label: tp, fp, fn, precision, recall, f1 of arrays of truths (0, 1) and probabilities."""
    rows = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(probs).alias("p"))).alias("k", "x")).select("k", F.col("x.t").alias("t"), (F.col("x.p") >= threshold).alias("g"))
    n = rows.groupBy("k").agg(F.count_if((F.col("t") == 1) & F.col("g")).alias("tp"), F.count_if((F.col("t") != 1) & F.col("g")).alias("fp"), F.count_if((F.col("t") == 1) & ~F.col("g")).alias("fn"))
    out = n.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("label"), "tp", "fp", "fn")
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def multilabel_summary(per_label: DataFrame) -> DataFrame:
    """One row: micro and macro means of multilabel()."""
    s = per_label.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])
    s = s.withColumns({"micro_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "micro_recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("micro_f1", f1_of(F.col("micro_precision"), F.col("micro_recall"))).drop("tp", "fp", "fn")


def constrained(minor_probs: Column, minor_majors: list[int], major: Column) -> Column:
    """Probabilities of minor labels, 0 where the label is not of the predicted major one."""
    return F.zip_with(minor_probs, F.array(*map(F.lit, minor_majors)), lambda p, m: F.when(m == major, p).otherwise(0.0))


def class_weights(df: DataFrame, label: str, labels: list[str], root: bool = False, cap: float | None = None) -> DataFrame:
    """Per label: count and total / (present labels * count), 0 for absent ones; its root, kept within 1/cap and cap, if asked for."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    full = grid(df, labels).join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    every = Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(every) / (F.count_if(F.col("n") > 0).over(every) * F.col("n"))
    weight = F.sqrt(weight) if root else weight
    if cap is not None:
        weight = F.least(F.greatest(weight, F.lit(1 / cap)), F.lit(cap))
    return full.select("id", "label", "n", F.when(F.col("n") > 0, weight).otherwise(0.0).alias("weight"))


def candidate_thresholds(df: DataFrame, score: str, steps: int = 999, quantiles: int = 301) -> DataFrame:
    """An even grid inside 0 to 1, and the scores' quantiles."""
    even = df.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("threshold"))
    at = F.array(*[F.lit(k / (quantiles - 1)) for k in range(quantiles)])
    return even.union(df.select(F.explode(F.percentile(score, at)).alias("threshold"))).distinct()


def reached(score: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds a score reaches, by binary search; 0 for null."""
    # One literal, which constant folding parses once.
    array = F.split(F.lit(",".join(map(repr, thresholds))), ",").cast("array<double>")

    def step(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        middle = F.shiftright(low + high, 1)
        hit = F.coalesce(F.get(array, middle) <= score, F.lit(False))
        return F.when(low >= high, at).otherwise(F.struct(F.when(hit, middle + 1).otherwise(low).alias("low"), F.when(hit, high).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(thresholds).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(thresholds)).alias("high")), step)["low"]


def threshold_sweep(df: DataFrame, score: str, target: Column, thresholds: DataFrame) -> DataFrame:
    """Per threshold: tp, fp, fn, tn, precision, recall, f1 of score >= threshold.

    Thresholds are few, as candidate_thresholds bounds them. Rows are counted by how many thresholds they reach, so that one row for each
    threshold comes to the driver, where they are summed up from the highest down.
    """
    marks = sorted(r[0] for r in thresholds.select("threshold").distinct().collect() if r[0] is not None)
    counted = df.groupBy(reached(F.col(score), marks).alias("at")).agg(F.count_if(target).alias("pos"), F.count_if(~target).alias("neg"))
    pos, neg = [0] * (len(marks) + 1), [0] * (len(marks) + 1)
    for r in counted.collect():
        pos[r["at"]], neg[r["at"]] = r["pos"], r["neg"]
    rows, tp, fp = [], 0, 0
    for k in range(len(marks), 0, -1):
        tp, fp = tp + pos[k], fp + neg[k]
        rows.append((marks[k - 1], tp, fp, sum(pos) - tp, sum(neg) - fp))
    return with_rates(df.sparkSession.createDataFrame(rows, "threshold double, tp long, fp long, fn long, tn long"))


def best_threshold(sweep: DataFrame, min_recall: float, min_f1: float) -> DataFrame:
    """The best by f1, recall, precision, few false positives, threshold, among those that pass if any does; one row with passed."""
    passed = (F.col("recall") >= min_recall) & (F.col("f1") >= min_f1)
    rank = F.struct(passed.alias("ok"), "f1", "recall", "precision", (-F.col("fp")).alias("nfp"), "threshold")
    return sweep.agg(F.max_by(F.struct(*sweep.columns, passed.alias("passed")), rank).alias("m")).select("m.*")


def calibrated(df: DataFrame, truth: str, probs: str, names: list[str], candidates: list[float]) -> DataFrame:
    """Per label the threshold of the highest f1, of equal ones the higher; 0.5 where no row has the label."""
    marks = sorted(set(candidates))
    rows = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(probs).alias("p"))).alias("k", "x")).select("k", (F.col("x.t") == 1).alias("t"), reached(F.col("x.p"), marks).alias("at"))
    # One row for each label and candidate is left before the candidates are tried.
    counted = rows.groupBy("k", "at").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))
    tried = counted.select("k", "at", "pos", "neg", F.explode(F.sequence(F.lit(1), F.lit(len(marks)))).alias("m"))
    over = lambda c: F.sum(F.when(F.col("at") >= F.col("m"), F.col(c)).otherwise(0))
    n = tried.groupBy("k", F.element_at(F.lit(marks), F.col("m")).alias("threshold")).agg(over("pos").alias("tp"), over("neg").alias("fp"), (F.sum("pos") - over("pos")).alias("fn"))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "support": F.col("tp") + F.col("fn")})
    n = n.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    best = n.groupBy("k").agg(F.max_by(F.struct("threshold", "f1", "precision", "recall", "support"), F.struct("f1", "threshold")).alias("m")).select("k", "m.*")
    some = F.col("support") > 0
    return best.select(F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("label"), F.when(some, F.col("threshold")).otherwise(0.5).alias("threshold"), *[F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in ("f1", "precision", "recall")], "support")


def overridden(guess: Column, score: Column, target: str, threshold: float, mode: str = "benign_only", benign: str = "benign") -> Column:
    """The prediction, or target where its score reaches the threshold and the prediction may be overridden."""
    may = {"benign_only": guess == benign, "target_or_benign": guess.isin(target, benign), "any": F.lit(True)}[mode]
    return F.when(may & (score >= threshold), target).otherwise(guess)


def decoded(logits: Column, names: list[str]) -> Column:
    """Struct label, prob, probs of the softmax of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(e, lambda x: x / total)
    best = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.struct(F.element_at(F.array(*map(F.lit, names)), best).alias("label"), F.array_max(probs).alias("prob"), probs.alias("probs"))
