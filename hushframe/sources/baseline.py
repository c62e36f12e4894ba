"""Published measurements, as fixtures for the analyses of them: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Milliseconds an alert with 16 workers and batches of one, by number of thresholds.
BY_K = ("k", [(20, 40.705), (50, 78.635), (100, 136.591), (200, 253.154), (500, 615.991)])
#: The same for 50 thresholds, by workers.
BY_WORKERS = ("workers", [(1, 960.409), (2, 488.776), (4, 247.316), (8, 133.884), (16, 78.193)])
#: The same without batches, one thread, by number of thresholds.
UNBATCHED = ("k", [(5, 96.459), (10, 192.84), (20, 385.908), (50, 956.206)])

#: For the 30 rows of the generated corpus, in its order, whether the analysis of the pseudonymised row had the severity and the actions of the analysis of the original one: full severity, full actions, hybrid severity, hybrid actions (1 yes). Technique and number of relationships agreed in all rows.
AGREEMENT = """
0 1 1 1
1 0 1 0
1 1 1 1
0 0 1 0
0 0 0 0
1 0 1 0
1 0 1 1
1 0 1 0
1 1 1 1
1 1 1 0
0 0 1 1
1 0 1 0
1 0 1 0
1 0 1 0
0 0 1 0
1 0 1 0
1 0 1 1
1 0 1 1
1 1 1 0
1 1 1 1
1 0 1 0
1 1 1 1
1 1 1 0
1 1 1 1
1 0 1 1
1 1 1 1
1 1 1 1
1 1 1 1
1 1 0 0
1 1 0 1
"""


def answers() -> list[tuple[int, str, bool, bool]]:
    """(row, mode, same severity, same actions) of AGREEMENT."""
    rows = [[x == "1" for x in line.split()] for line in AGREEMENT.split("\n") if line]
    return [(i, mode, r[2 * k], r[2 * k + 1]) for i, r in enumerate(rows) for k, mode in enumerate(("full", "hybrid"))]


def table(spark: SparkSession, fixture) -> DataFrame:
    return spark.createDataFrame(fixture[1], f"{fixture[0]} int, ms double")


def sql(fixture) -> str:
    rows = ", ".join(f"({a}, {b}::double)" for a, b in fixture[1])
    return f"(values {rows}) t({fixture[0]}, ms)"


def answers_sql() -> str:
    return "(values " + ", ".join(f"({i}, '{m}', {s}, {a})" for i, m, s, a in answers()) + ") t(row, mode, severity, actions)"
