"""Comparison of the analyses of original and pseudonymised records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, same_set

FIELDS = ("technique", "severity", "actions", "relationships")


def compared(original: DataFrame, other: DataFrame, truth: DataFrame, key: str = "alert_id") -> DataFrame:
    """One row for each key of both: what is equal, what got lost, and a note. original and other have key and FIELDS; truth has key and technique."""
    a, b = (df.select(key, *[F.col(f).alias(f"{f}_{x}") for f in FIELDS]) for df, x in ((original, "a"), (other, "b")))
    both = a.join(b, key).join(truth.select(key, F.col("technique").alias("truth")), key)
    right_a, right_b = (F.col("technique_a") == F.col("truth"), F.col("technique_b") == F.col("truth"))
    both = both.select(
        key, right_a.alias("right_a"), right_b.alias("right_b"), (F.col("technique_a") == F.col("technique_b")).alias("same_technique"), (F.col("severity_a") == F.col("severity_b")).alias("same_severity"),
        same_set(F.col("actions_a"), F.col("actions_b")).alias("same_actions"), F.round(jaccard(F.col("actions_a"), F.col("actions_b")), 6).alias("jaccard"),
        (F.size("relationships_b") < F.size("relationships_a")).alias("fewer"), (right_a & ~right_b).alias("hallucination"),
    )
    # The four notes: fixed values.
    note = F.when(~F.col("right_a"), "A misses ground truth").when(F.col("hallucination"), "B diverges from ground truth")
    return both.withColumn("note", note.when(~F.col("same_severity") | ~F.col("same_actions") | F.col("fewer"), "reasoning detail changed").otherwise("—"))


def agreement(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts over compared() rows."""
    n = {"technique": F.col("same_technique"), "severity": F.col("same_severity"), "actions": F.col("same_actions"), "all_three": F.col("same_technique") & F.col("same_severity") & F.col("same_actions"), "fewer": F.col("fewer"), "hallucination": F.col("hallucination"), "jaccard_half": F.col("jaccard") >= 0.5}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in n.items()], F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.every("same_technique").alias("all_same"))


def accuracy(answers: DataFrame, truth: DataFrame, key: str, by: str) -> DataFrame:
    """Of each group the answers and the right ones."""
    return answers.join(truth, key).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == F.col("truth")).alias("right"))


#: Lines of the report, with the columns of agreement() that they show.
MEASURES = (("Same technique", "technique"), ("Same severity", "severity"), ("Same set of actions", "actions"), ("Action overlap of one half or more", "jaccard_half"), ("Technique, severity and actions", "all_three"), ("Fewer relationships", "fewer"), ("Technique lost by pseudonymisation", "hallucination"))


def report(rows: DataFrame, by: str) -> DataFrame:
    """agreement() of each value of `by`, a line a measure, as shares of the rows: by, line, measure, share. Small enough to be written as a table (sources.tables.as_markdown)."""
    counts = agreement(rows, [by])
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(name).alias("measure"), F.format_string("%d/%d", F.col(c), F.col("n")).alias("share")) for i, (name, c) in enumerate(MEASURES)])
    return counts.select(by, F.explode(lines).alias("l")).select(by, "l.*")
