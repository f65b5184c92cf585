"""From labelled corpora to what may be shown: corpora read strictly, rules that their evaluation approves, live checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.operators.evaluation import leakage, repeated_cases

GATE_CASES = "case_id string, partition string, rule string, label string, coordinates array<string>, evidence array<string>"
MOTIF_CASES = "case_id string, partition string, motif string, sessions array<string>, evidence array<string>"


def read_cases(spark: SparkSession, path: str, schema: str = GATE_CASES, disjoint: tuple[str, ...] = ("coordinates", "evidence")) -> DataFrame:
    """A corpus of JSON lines, whole or not at all.

    Refused are lines that do not fit the schema, rows without an id or a partition, an empty corpus, ids that occur twice, and
    values of ``disjoint`` columns that occur in more than one partition.
    """
    cases = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    facts = cases.agg(F.count("*").alias("n"), F.count_if(F.col("case_id").isNull() | F.col("partition").isNull()).alias("blank")).head()
    if not facts["n"]:
        raise ValueError("the corpus is empty")
    if facts["blank"]:
        raise ValueError(f"{facts['blank']} cases lack an id or a partition")
    if twice := repeated_cases(cases).limit(3).collect():
        raise ValueError("cases occur twice: " + ", ".join(r["case_id"] for r in twice))
    for column in disjoint:
        if shared := leakage(cases, column).limit(3).collect():
            raise ValueError(f"{column} occur in several partitions: " + ", ".join(r["value"] for r in shared))
    return cases


def surfaced(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Candidates of rules that their evaluation lets surface; both have ``rule``, ``decided`` also ``decision``."""
    return candidates.join(decided.where("decision = 'surface'").select("rule").distinct(), "rule", "left_semi")


def to_append(candidates: DataFrame, decided: DataFrame | None) -> DataFrame:
    """``surfaced`` candidates, or an error: nothing is appended without an evaluation, or if it approves none of them."""
    if decided is None:
        raise ValueError("candidates are appended only after an evaluation")
    shown = surfaced(candidates, decided)
    if shown.isEmpty():
        raise ValueError("no candidate belongs to a rule that may surface")
    return shown


def state_counts(assessments: DataFrame, *by: str) -> DataFrame:
    """Assessments by state, of each group of ``by``."""
    return assessments.groupBy(*by, "state").agg(F.count("*").alias("n"))


def live_sample(facets: DataFrame, positives: int, controls: int) -> DataFrame:
    """``session_id, positive``: the first sessions, by id, with a repeated failure, and the first that failed without one.

    A spot check by design: both numbers are the caller's.
    """
    repeated = F.col("repeated_failure_fingerprint").isNotNull()
    first = lambda which, n, said: facets.where(which).orderBy("session_id").limit(n).select("session_id", F.lit(said).alias("positive"))
    return first(repeated, positives, True).unionByName(first((F.col("failed_tool_attempts") > 0) & ~repeated, controls, False))


def live_metrics(sample: DataFrame, assigned: DataFrame, recall_at: float, tolerance: float = 0.15, precision_floor: float = 0.9) -> DataFrame:
    """``assigned, correct, missed, precision, recall, within_tolerance`` of one motif's assigned sessions against a sample."""
    marks = assigned.select("session_id").distinct().withColumn("given", F.lit(True))
    both = sample.where("positive").join(marks, "session_id", "full")
    given, real = F.coalesce("given", F.lit(False)), F.coalesce("positive", F.lit(False))
    out = both.agg(F.count_if(given).alias("assigned"), F.count_if(given & real).alias("correct"), F.count_if(real & ~given).alias("missed"))
    share = lambda whole: F.round(F.try_divide(F.col("correct").cast("double"), whole), 6)
    out = out.withColumns({"precision": share(F.col("assigned")), "recall": share(F.col("correct") + F.col("missed"))})
    fine = (F.col("precision") >= precision_floor) & (F.abs(F.col("recall") - recall_at) <= tolerance)
    return out.withColumn("within_tolerance", F.coalesce(fine, F.lit(False)))
