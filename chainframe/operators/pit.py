"""Point-in-time features, labels, training rows and scoring."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.scalar import floordiv
from chainframe.operators.aggs import gram, with_ordinal
from chainframe.operators.joins import asof, model_at
from chainframe.sources.tables import checkpoint, checkpoint_folder


def feature_rows(events: DataFrame, at: str, warm_ups: Sequence[int], values: Sequence[str], row_id: str) -> DataFrame:
    """Features are available at the event plus the longest warm-up."""
    return events.select(row_id, F.col(at).alias("effective"), (F.col(at) + max(warm_ups, default=0)).alias("available"), *values)


def universe_rows(features: DataFrame) -> DataFrame:
    """Each row may be decided on for one step from when it is available."""
    return features.select("row_id", F.col("available").alias("eligible_from"), (F.col("available") + 1).alias("eligible_until"), F.col("available").alias("input_available"))


def label_rows(rows: DataFrame, at: str, value: str, horizon: int, cutoff: int) -> DataFrame:
    """Labels whose future lies at or before the cutoff."""
    return rows.withColumn("future_used", F.col(at) + horizon).where(F.col("future_used") <= cutoff).withColumn("label", F.col(value))


def lookahead_violations(df: DataFrame, effective: str, available: str, future: str | None = None) -> DataFrame:
    bad = F.when(F.col(available) < F.col(effective), "AVAILABLE_BEFORE_EFFECTIVE")
    if future:
        bad = bad.when(F.col(future) < F.col(effective), "FUTURE_BEFORE_EFFECTIVE")
    return df.withColumn("rule", bad).where("rule is not null")


def temporal_split(df: DataFrame, at: str, train_until: int, purge: int, test_from: int) -> DataFrame:
    """split: TRAIN, TEST or PURGED between them."""
    if train_until > test_from:
        raise ValueError("training must end before the test begins")
    return df.withColumn("split", F.when(F.col(at) < train_until - purge, "TRAIN").when(F.col(at) >= test_from, "TEST").otherwise("PURGED"))


def training_rows(labels: DataFrame, universe: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Labelled rows of the universe with their features; fails if one lacks a feature row or has a late one."""
    rows = labels.where("label is not null").join(universe, "row_id").join(features.select("row_id", "available", *names), "row_id", "left")
    if rows.where("available is null or available > eligible_from").limit(1).count():
        raise ValueError("a feature is missing or late")
    return rows


def training_set(labels: DataFrame, universe: DataFrame, features: DataFrame, names: Sequence[str], train_from: int, train_until: int, cutoff: int) -> DataFrame:
    """row_id, at, label and a column for each of ``names``: what may be trained on at train_from <= at < train_until.

    ``labels``: row_id, entity, at, label, future_used. ``universe``: row_id, eligible_from, eligible_until; a row takes part if one of its intervals holds ``at``.
    ``features``: name, entity, available, value, of any number of feature sets; a row gets the last value of its entity that was available by ``at`` (of equal times
    the greatest). Rows without a label are left out. Fails if a label has used what lies behind ``cutoff``, if a feature is missing or came too late for
    a row, or if nothing is left. Null entities meet each other.

    All sets and all decisions are one stream that is scanned once by (name, entity); decisions stand in it once for each name.
    """
    split = labels.where((F.col("at") >= train_from) & (F.col("at") < train_until))
    if split.where(F.col("future_used") > cutoff).limit(1).count():
        raise ValueError("a label uses data after the cutoff")
    inside = universe.select(F.col("row_id").alias("_row"), "eligible_from", "eligible_until")
    known = split.where("label is not null").join(inside, (F.col("row_id") == F.col("_row")) & (F.col("at") >= F.col("eligible_from")) & (F.col("at") < F.col("eligible_until")), "left_semi")
    asked = known.select("row_id", "entity", "at", "label", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    told = features.groupBy("name", "entity", F.col("available").alias("_from")).agg(F.max("value").alias("value"))
    met = asof(asked, told, ["name", "entity"], "at", "_from", ["value"])
    out = met.groupBy("row_id", "at", "label").agg(F.count_if(F.col("value").isNull()).alias("_lacks"), *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    out = checkpoint(out)
    if out.where("_lacks > 0").limit(1).count():
        raise ValueError("a feature is missing or not yet available")
    if out.isEmpty():
        raise ValueError("no rows to train on")
    return out.drop("_lacks")


def fit_ridge(df: DataFrame, x: Sequence[str], y: str, penalty: int) -> list[Fraction]:
    """Ridge regression from exact sums; the intercept comes first and has no penalty. Only the sums leave the cluster."""
    return fit_ridge_and_error(df, x, y, penalty)[0]


def fit_ridge_and_error(df: DataFrame, x: Sequence[str], y: str, penalty: int) -> tuple[list[Fraction], Fraction]:
    """The coefficients of fit_ridge() and the sum of squared errors on the rows they come from, both exact. Fails if the columns depend on one another."""
    s, k = gram(df, x, y).first().asDict(), len(x) + 1
    at = lambda i, j: Fraction(int(s[f"x{min(i, j)}_x{max(i, j)}"] or 0))
    target = [Fraction(int(s[f"x{i}_y"] or 0)) for i in range(k)]
    fitted = _solve([[at(i, j) + (penalty if i == j and i else 0) for j in range(k)] + [target[i]] for i in range(k)])
    error = Fraction(int(s["y_y"] or 0)) - 2 * sum(b * t for b, t in zip(fitted, target, strict=True)) + sum(fitted[i] * fitted[j] * at(i, j) for i in range(k) for j in range(k))
    return fitted, error


def _solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a square system, whose right side is the last column."""
    for c in range(len(rows)):
        pivot = next((r for r in range(c, len(rows)) if rows[r][c]), None)
        if pivot is None:
            raise ValueError("the columns depend on one another")
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [v / rows[c][c] for v in rows[c]]
        for r in range(len(rows)):
            if r != c and rows[r][c]:
                factor = rows[r][c]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[c], strict=True)]
    return [r[-1] for r in rows]


def score(features: DataFrame, schedule: DataFrame, at: str, names: Sequence[str], missing: str = "NULL", also: Sequence[str] = ()) -> DataFrame:
    """prediction = floor((bias + sum(w * x)) / divisor) of the model that holds at the row; prediction_available is the latest of its inputs:
    of the row's available, the model's model_available, and the columns ``also``, such as when the model was fitted and when the run ended.

    ``schedule``: valid_from, valid_until, model_id, model_available, bias, divisor, weights (array, in the order of names).
    """
    rows = model_at(features, schedule, at)
    total = F.col("bias").cast("decimal(38,0)")
    for i, c in enumerate(names):
        total = (total + F.element_at("weights", i + 1).cast("decimal(18,0)") * F.col(c).cast("decimal(18,0)")).cast("decimal(38,0)")
    lacking = F.lit(False)
    for c in names:
        lacking = lacking | F.col(c).isNull()
    if missing == "FAIL" and rows.where(lacking).limit(1).count():
        raise ValueError("a feature is missing")
    return rows.withColumns({"prediction": F.when((F.col("status") == "SCORED") & ~lacking, floordiv(total, F.col("divisor"))), "prediction_available": F.greatest("available", "model_available", *also)})


def check_schedule(schedule: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Models that overlap the next one of their schedule, end before they begin or come after their start.

    ``by`` tells the schedules of a table apart; one schedule by itself is a sorted list and fits one task.
    """
    nxt = F.lead("valid_from").over(Window.partitionBy(*by).orderBy("valid_from", "model_id"))
    rule = F.when(F.col("valid_until") <= F.col("valid_from"), "EMPTY").when(nxt < F.col("valid_until"), "OVERLAP").when(F.col("model_available") > F.col("valid_from"), "LATE_MODEL")
    return schedule.withColumn("rule", rule).where("rule is not null")


def split_purged(df: DataFrame, at: str, known_at: str, label: str, cut: Column) -> DataFrame:
    """TRAIN before the cut if the label was known by then, PURGED if not, UNKNOWN without a label, TEST from the cut on."""
    return df.withColumn("split", F.when(F.col(label).isNull(), "UNKNOWN").when(F.col(at) >= cut, "TEST").when(F.col(known_at) > cut, "PURGED").otherwise("TRAIN"))


def split_by_rank(df: DataFrame, order: Sequence[str], at: str, label: str, known_at: str, tenths: int = 7) -> DataFrame:
    """Adds split: the first ``tenths`` tenths of the rows in order, rounded down, train, the others test.

    TRAIN; PURGED_TRAIN where the label isn't known before the first test row's ``at``; UNKNOWN_TRAIN and UNKNOWN_TEST without a label; TEST. Rows are numbered by
    ranges, so no task holds all. ``order`` begins with ``at`` and is total.
    """
    rows = with_ordinal(df, order, "_i")
    cut = df.count() * tenths // 10
    first = rows.where(F.col("_i") == cut).select(F.col(at).alias("_start"))
    train, unknown = F.col("_i") < cut, F.col(label).isNull()
    late = F.coalesce(F.col(known_at) >= F.col("_start"), F.lit(True))
    split = F.when(unknown & train, "UNKNOWN_TRAIN").when(unknown, "UNKNOWN_TEST").when(~train, "TEST").when(late, "PURGED_TRAIN").otherwise("TRAIN")
    return rows.join(F.broadcast(first)).withColumn("split", split).drop("_i", "_start")


def fit_logistic(df: DataFrame, names: Sequence[str], label: str):
    """A pipeline of standardisation and logistic regression, fitted on the cluster.

    It is written and read again without the summary of its fit, as that holds the session, which can't be sent to tasks once rows have been observed.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=list(names), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label)]
    path = f"{checkpoint_folder(df.sparkSession)}/fit-{uuid.uuid4().hex}"
    Pipeline(stages=steps).fit(df).save(path)
    return PipelineModel.load(path)


def binary_metrics(df: DataFrame, probability: str, label: str) -> DataFrame:
    p, y = F.col(probability), F.col(label).cast("double")
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"))
