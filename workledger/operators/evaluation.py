"""Held-out evaluation of detectors: leakage, coverage, metrics and what they allow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Floors:
    surface: float = 0.9
    narrow: float = 0.8
    recurrence: int = 3
    aggregation: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.narrow <= self.surface <= 1:
            raise ValueError("floors must rise from narrow to surface within 0 and 1")


def leakage(cases: DataFrame, value: str) -> DataFrame:
    """Values (coordinates or evidence) that occur in more than one partition. ``cases``: partition and the
    array column ``value``."""
    return (
        cases.select("partition", F.explode(value).alias("value"))
        .groupBy("value")
        .agg(F.countDistinct("partition").alias("partitions"), F.count("*").alias("uses"))
        .where("partitions > 1")
    )


def repeated_cases(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def uncovered(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evaluated cases without a prediction and predictions without a case; must be empty."""
    wanted = cases.where("partition in ('held-out', 'calibration')").select("case_id")
    return wanted.join(predictions.select("case_id"), "case_id", "left_anti").withColumn("missing", F.lit("prediction")).unionByName(
        predictions.select("case_id").join(wanted, "case_id", "left_anti").withColumn("missing", F.lit("case"))
    )


def metrics(judged: DataFrame, *by: str, floors: Floors = Floors()) -> DataFrame:
    """Confusion counts, precision and coverage of rows ``expected, predicted`` (booleans; null: ambiguous, abstain).

    A predicted finding on an ambiguous case is a false positive. Optional columns ``recurrences`` and
    ``aggregation`` of predicted findings are held against the floors.
    """
    hit, miss, abstain = F.col("predicted"), ~F.col("predicted"), F.col("predicted").isNull()
    right = F.coalesce(F.col("expected"), F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    below = lambda name, least: count(hit & (F.col(name) < least)) if name in judged.columns else F.lit(0).cast("long")
    out = judged.groupBy(*by).agg(
        F.count("*").alias("n_cases"),
        count(hit & right).alias("true_positive"),
        count(hit & ~right).alias("false_positive"),
        count(miss & ~right).alias("true_negative"),
        count(miss & right).alias("false_negative"),
        count(abstain).alias("abstained"),
        count(F.col("expected").eqNullSafe(F.col("predicted"))).alias("exact"),
        below("recurrences", floors.recurrence).alias("recurrence_violations"),
        below("aggregation", floors.aggregation).alias("aggregation_violations"),
    )
    positive = F.col("true_positive") + F.col("false_positive")
    return out.withColumn("precision", F.round(F.try_divide(F.col("true_positive").cast("double"), positive), 6)).withColumn(
        "coverage", F.round((F.col("n_cases") - F.col("abstained")).cast("double") / F.col("n_cases"), 6)
    )


def decide(measured: DataFrame, floors: Floors = Floors()) -> DataFrame:
    """``measured`` with ``decision``: surface, narrow or offline."""
    sound = (F.col("true_positive") > 0) & (F.col("recurrence_violations") == 0) & (F.col("aggregation_violations") == 0)
    return measured.withColumn(
        "decision",
        F.when(sound & (F.col("precision") >= floors.surface), "surface")
        .when(sound & (F.col("precision") >= floors.narrow), "narrow")
        .otherwise("offline"),
    )


def expected_of_label(label: str = "label"):
    """Expected finding of a case label: supported yes, ambiguous unknown, others no."""
    c = F.col(label)
    return F.when(c == "supported", True).when(c != "ambiguous", False)


def evaluate_gate_cases(cases: DataFrame, assessments: DataFrame, floors: Floors = Floors()) -> DataFrame:
    """Per rule, held-out metrics and decision. ``cases``: case_id, partition, rule, label; ``assessments``:
    case_id, rule, state. A case without exactly one assessment of its rule counts as abstained."""
    one = assessments.groupBy("case_id", "rule").agg(F.count("*").alias("n"), F.first("state").alias("state"))
    predicted = F.when((F.col("n") != 1) | (F.col("state") == "abstain"), F.lit(None).cast("boolean")).otherwise(F.col("state") == "detected")
    judged = cases.where("partition = 'held-out'").join(one, ["case_id", "rule"], "left")
    judged = judged.withColumn("expected", expected_of_label()).withColumn("predicted", predicted)
    return decide(metrics(judged, "rule", floors=floors), floors)


def as_later_case(labels: DataFrame) -> DataFrame:
    """Calibration labels as cases of the next corpus."""
    return labels.select(F.concat(F.lit("cal:"), "label_id").alias("case_id"), F.lit("calibration").alias("partition"), "rule", "label", "evidence")


def method_scores(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall, operator value and stability of methods.

    ``assigned``: method, seed, case_id, motif. ``expected``: case_id, motif. Operator value is the share of
    motifs with at least three assignments; stability the Jaccard similarity of two seeds' assignments.
    """
    total = expected.agg(F.count("*").alias("total"))
    right = expected.withColumn("__right", F.lit(1))
    marked = assigned.join(right, ["case_id", "motif"], "left")
    per_seed = marked.groupBy("method", "seed").agg(F.count("*").alias("given"), F.count("__right").alias("right"))
    sizes = assigned.groupBy("method", "seed", "motif").agg(F.count("*").alias("n")).groupBy("method", "seed").agg(F.avg(F.when(F.col("n") >= 3, 1.0).otherwise(0.0)).alias("value"))
    scores = per_seed.join(sizes, ["method", "seed"]).join(F.broadcast(total)).groupBy("method").agg(
        F.round(F.avg(F.col("right") / F.col("given")), 6).alias("precision"),
        F.round(F.avg(F.col("right") / F.col("total")), 6).alias("recall"),
        F.round(F.avg("value"), 6).alias("operator_value"),
    )
    seeds = assigned.select("method", "seed").distinct().groupBy("method").agg(F.count("*").alias("n_seeds"))
    shared = assigned.groupBy("method", "case_id", "motif").agg(F.countDistinct("seed").alias("k")).join(seeds, "method")
    stable = shared.groupBy("method").agg(F.round(F.avg(F.when(F.col("k") == F.col("n_seeds"), 1.0).otherwise(0.0)), 6).alias("stability"))
    return scores.join(stable, "method")


def choose_method(scores: DataFrame, precision: float = 0.9, stability: float = 0.8) -> DataFrame:
    """The method with the largest value among those above the floors."""
    good = scores.where((F.col("precision") >= precision) & (F.col("stability") >= stability))
    return good.agg(F.max_by("method", F.struct("operator_value", "recall", "precision", "method")).alias("method"))


def first_per_class(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each class."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def arm_summary(calls: DataFrame) -> DataFrame:
    """Score, errors and their change between the two arms of a comparison, per operation."""
    return (
        calls.groupBy("operation")
        .pivot("arm", ["baseline", "variant"])
        .agg(F.round(F.avg("score"), 6).alias("score"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        .withColumn("delta", F.round(F.col("variant_score") - F.col("baseline_score"), 6))
    )


def rubric_score(action: str, checks: list[str]):
    """0.60 for the action and 0.10 for each of four checks; columns are booleans."""
    one = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    total = one(action) * 0.60
    for c in checks:
        total = total + one(c) * 0.10
    return F.round(total, 6)
