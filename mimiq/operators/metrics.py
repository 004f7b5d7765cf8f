"""Evaluation metrics as aggregations, and a runner over labelled splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import q

#: Class numbers of emotion labels, and both vocabularies of predicted columns.
EMOTION_CLASSES = {"neutral": 0, "happiness": 1, "sadness": 2, "surprise": 3, "fear": 4, "disgust": 5, "anger": 6}
EMOTION_ALIASES = {"Neutral": "neutral", "Happy": "happiness", "Sad": "sadness", "Surprise": "surprise", "Fear": "fear", "Disgust": "disgust", "Anger": "anger"}


def f1_of(truth: Column, predicted: Column) -> Column:
    """F1 of 0/1 columns; 0 where neither side has a positive."""
    both = F.sum(F.when((truth == 1) & (predicted == 1), 1).otherwise(0))
    one = F.sum(F.when((truth == 1) != (predicted == 1), 1).otherwise(0))
    return F.when(2 * both + one > 0, 2 * both / F.when(2 * both + one > 0, 2 * both + one)).otherwise(0.0)


def icc_of(x: Column, y: Column) -> Column:
    """Consistency of two raters, (MSR - MSE) / (MSR + MSE); 0 where it is not defined.

    With two raters, MSR is twice the sample variance of row means and MSE half that of
    differences, so both come from variances and one pass suffices.
    """
    msr, mse = 2 * F.var_samp((x + y) / 2), F.var_samp(x - y) / 2
    return F.coalesce(F.when(msr + mse > 1e-12, (msr - mse) / F.when(msr + mse > 1e-12, msr + mse)), F.lit(0.0))


def ccc_of(x: Column, y: Column) -> Column:
    """Concordance of population moments; 0 for fewer than two rows or no spread."""
    base = F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), F.lit(2))
    return F.coalesce(F.when((F.count(x) >= 2) & (base > 1e-12), 2 * F.covar_pop(x, y) / F.when(base > 1e-12, base)), F.lit(0.0))


def accuracy_of(truth: Column, predicted: Column) -> Column:
    return F.avg((truth == predicted).cast("double"))


def f1_macro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: mean F1 over all classes that either side has."""
    rows = df.filter(q(truth).isNotNull() & q(predicted).isNotNull()).groupBy(q(truth).alias("t"), q(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = rows.select(F.col("t").alias("c"), "n", hit.alias("h")).unionAll(rows.select(F.col("p").alias("c"), "n", hit.alias("h")))
    # a class's hits come once from either side: 2 tp over (tp + fn) + (tp + fp)
    return sides.groupBy("c").agg((F.sum("h") / F.sum("n")).alias("f1")).agg(F.avg("f1").alias("f1_macro"))


def summarize_aus(long: DataFrame, truth_threshold: float = 2, pred_threshold: float = 0.5) -> DataFrame:
    """au, n, f1, icc of rows (au, truth, prob) that have both."""
    rows = long.filter("truth is not null and prob is not null")
    t, p = (F.col("truth") >= truth_threshold).cast("int"), (F.col("prob") >= pred_threshold).cast("int")
    return rows.groupBy("au").agg(F.count("*").alias("n"), f1_of(t, p).alias("f1"), icc_of(F.col("truth").cast("double"), F.col("prob").cast("double")).alias("icc"))


def unpivot_pairs(df: DataFrame, truth: Sequence[str], predicted: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(au, truth, prob) from two sets of columns."""
    cells = [F.struct(F.lit(n).alias("au"), q(t).cast("double").alias("truth"), q(p).cast("double").alias("prob")) for n, t, p in zip(names, truth, predicted, strict=True)]
    return df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by ranks, ties averaged.

    Scores are counted first; ranks come from running counts over ranges of the
    different scores, so no task holds all rows.
    """
    counts = df.filter(q(label).isNotNull() & q(score).isNotNull()).groupBy(q(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum((q(label) == 1).cast("long")).alias("pos"))
    below = running_total(counts, "s", "n")
    both = below.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    pairs = F.col("p") * neg
    return both.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when(pairs > 0, pairs)).alias("auc"))


def running_total(df: DataFrame, key: str, value: str, parts: int = 64) -> DataFrame:
    """Add ``before``: the sum of value over all smaller keys, from sums of ranges of the key."""
    marks = df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.001)
    part = sum((F.when(q(key) > m, 1).otherwise(0) for m in sorted(set(marks))), F.lit(0))
    split = df.withColumn("__part", part)
    sums = split.groupBy("__part").agg(F.sum(value).alias("__sum"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most ``parts`` rows
    return split.join(F.broadcast(base), "__part").withColumn("before", F.col("__base") + inside).drop("__part", "__base")


def verification_folds(pairs: DataFrame, similarity: str, same: str, fold: str, steps: int = 400) -> DataFrame:
    """fold, threshold, accuracy: for each fold the threshold best on the others, and its accuracy there.

    Thresholds are ``steps`` even ones from least to greatest similarity; of equal ones the least.
    Each row adds to one cell of a histogram over thresholds and folds.
    """
    rows = pairs.select(q(similarity).cast("double").alias("s"), q(same).cast("int").alias("y"), q(fold).alias("f")).filter("s is not null and y is not null and f is not null")
    ends = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / (steps - 1)
    at = lambda k: F.col("lo") + k * width
    # k: the last threshold that s reaches; arithmetic may be off by one, so it is settled by comparison
    guess = F.when(width > 0, F.floor((F.col("s") - F.col("lo")) / F.when(width > 0, width))).otherwise(steps - 1)
    near = F.least(F.greatest(guess, F.lit(0)), F.lit(steps - 1))
    k = F.when((near < steps - 1) & (F.col("s") >= at(near + 1)), near + 1).when((near > 0) & (F.col("s") < at(near)), near - 1).otherwise(near)
    cells = rows.crossJoin(F.broadcast(ends)).select("f", "y", k.cast("int").alias("k")).groupBy("f", "k").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    folds = rows.groupBy("f").agg(F.sum("y").alias("P"), F.sum(1 - F.col("y")).alias("N"))
    grid = folds.crossJoin(rows.sparkSession.range(steps).select(F.col("id").cast("int").alias("k")))  # folds x steps cells
    table = grid.join(cells, ["f", "k"], "left").na.fill(0, ["pos", "neg"])
    up = Window.partitionBy("f").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    right = table.select("f", "k", (F.col("P") - below("pos") + below("neg")).alias("right"), (F.col("P") + F.col("N")).alias("n"))
    every = Window.partitionBy("k")
    train = right.withColumn("acc", (F.sum("right").over(every) - F.col("right")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0)))
    best = train.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("acc"), "k"))).filter("r = 1")
    return best.crossJoin(F.broadcast(ends)).select(F.col("f").alias("fold"), at(F.col("k")).alias("threshold"), (F.col("right") / F.col("n")).alias("accuracy"))


def verification_10fold(pairs: DataFrame, similarity: str = "similarity", same: str = "same_id", fold: str = "fold") -> DataFrame:
    """One row: accuracy_mean, accuracy_std (population), threshold_mean, n_folds, auc."""
    folds = verification_folds(pairs, similarity, same, fold)
    out = folds.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("threshold").alias("threshold_mean"), F.count("*").alias("n_folds"))
    return out.crossJoin(F.broadcast(rank_auc(pairs, same, similarity)))


def rank_k(matches: DataFrame, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """One row: rank_k for each k and n_probes, of rows (probe, rank, hit) with the nearest max(ks) of each probe."""
    made = [F.max(F.when(F.col("hit") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}") for k in ks]
    return matches.groupBy("probe").agg(*made).agg(*[F.avg(F.col(f"h{k}").cast("double")).alias(f"rank_{k}") for k in ks], F.count("*").alias("n_probes"))


def top_face(df: DataFrame, frame: str = "frame", score: str = "FaceScore", tie: Sequence[str] = ()) -> DataFrame:
    """The row of best score of each frame."""
    order = Window.partitionBy(q(frame)).orderBy(F.desc_nulls_last(q(score)), *map(q, tie))
    return df.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def align_to_frames(top: DataFrame, n_frames: int, frame: str = "frame") -> DataFrame:
    """A row for each of 0 … n_frames - 1, NULL where the table has none."""
    return top.sparkSession.range(n_frames).select(F.col("id").alias(frame)).join(top, frame, "left")


def gaze_errors(df: DataFrame, truth: tuple[str, str], predicted: tuple[str, str]) -> DataFrame:
    """One row of degrees: mean, population deviation, median of the angle, and mean absolute pitch and yaw errors."""
    from ..functions.gaze import angular_error_degrees

    e = df.select(angular_error_degrees(q(truth[0]), q(truth[1]), q(predicted[0]), q(predicted[1])).alias("e"), F.abs(F.degrees(q(truth[0]) - q(predicted[0]))).alias("p"), F.abs(F.degrees(q(truth[1]) - q(predicted[1]))).alias("y")).filter("e is not null")
    return e.agg(F.avg("e").alias("gaze_angular_error_deg"), F.stddev_pop("e").alias("gaze_angular_error_std"), F.median("e").alias("gaze_angular_error_median"), F.avg("p").alias("gaze_pitch_mae_deg"), F.avg("y").alias("gaze_yaw_mae_deg"), F.count("*").alias("n"))


def emotion_class(columns: Sequence[str]) -> Column:
    """Class number of the greatest of emotion columns of either vocabulary, the first of equals; NULL if any is missing."""
    values = F.array(*map(q, columns))
    classes = F.array(*[F.lit(EMOTION_CLASSES[EMOTION_ALIASES.get(c, c)]) for c in columns])
    return F.when(~F.exists(values, lambda v: v.isNull()), F.element_at(classes, F.array_position(values, F.array_max(values)).cast("int")))


def evaluate(top: DataFrame, labels: DataFrame, kind: str, frame: str = "frame", **how: object) -> DataFrame:
    """Score the top faces of a split against its labels, both by frame. kind is au, emotion, gaze or valence_arousal.

    Every label row counts in n_images; n_faces counts rows that are detections.
    """
    joined = labels.join(top, frame, "left")
    seen = joined.agg(F.count("*").alias("n_images"), F.sum(F.coalesce((F.col("FaceScore") > 0).cast("long"), F.lit(0))).alias("n_faces")) if "FaceScore" in top.columns else joined.agg(F.count("*").alias("n_images"))
    if kind == "au":
        names = list(how["aus"])
        per = summarize_aus(unpivot_pairs(joined, [f"true_{a}" for a in names], names, names))
        scores = per.agg(F.round(F.avg("f1"), 4).alias("mean_f1"), F.round(F.avg("icc"), 4).alias("mean_icc"), F.count("*").alias("n_aus"))
    elif kind == "emotion":
        cls = joined.select(q(str(how.get("label", "expression_int"))).alias("t"), emotion_class(list(how["columns"])).alias("p")).filter("p is not null")
        scores = cls.agg(accuracy_of(F.col("t"), F.col("p")).alias("accuracy"), F.count("*").alias("n_scored")).crossJoin(F.broadcast(f1_macro(cls, "t", "p")))
    elif kind == "gaze":
        scores = gaze_errors(joined, ("gaze_pitch_rad", "gaze_yaw_rad"), ("gaze_pitch", "gaze_yaw"))
    elif kind == "valence_arousal":
        scores = joined.agg(*[ccc_of(q(f"true_{c}"), q(c)).alias(f"{c}_ccc") for c in ("valence", "arousal")])
    else:
        raise ValueError(f"{kind} splits are not scored by frame")
    return seen.crossJoin(F.broadcast(scores))
