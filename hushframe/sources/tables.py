"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from .prng import Stream

#: The labels of the generated corpus, its processes, their parents: fixed values, in order.
TECHNIQUES = ("credential_dumping", "lateral_movement", "phishing", "data_exfiltration", "privilege_escalation", "ransomware_preparation")
PROCESSES = ("rundll32.exe", "psexec.exe", "outlook.exe", "rclone.exe", "fodhelper.exe", "vssadmin.exe")
PARENTS = ("wininit.exe", "svchost.exe", "explorer.exe", "powershell.exe", "cmd.exe", "powershell.exe")
SEED, VARIANTS = 0xADA40030, 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def drawn(seed: int = SEED) -> list[tuple]:
    """The columns of the corpus that come from the pseudo-random stream: id, timestamp, pid and bytes of each of the 30 rows."""
    s, rows = Stream(seed), []
    for i in range(len(TECHNIQUES) * VARIANTS):
        number = s.u64()
        day, minute = s.below(28) + 1, s.below(60)
        rows.append((i // VARIANTS, i % VARIANTS, f"ALRT-{number:016x}", f"2026-01-{day:02d}T12:{minute:02d}:00Z", s.below(49_000) + 1000, s.below(4_998_976, 64) + 1024))
    return rows


def alerts(spark: SparkSession) -> DataFrame:
    """The generated corpus: six techniques in five variants each. Its accounts, machines, addresses, paths, domains, hashes and the templates of its command lines and relationships are fixed values."""
    t, v = F.col("t"), F.col("v")
    odd = v % 2 == 1
    users = F.concat(F.lit("C:\\Users\\analyst"), v.cast("string"), F.lit("\\Downloads\\"))
    rows = spark.range(len(TECHNIQUES)).select(F.col("id").alias("t")).crossJoin(spark.range(VARIANTS).select(F.col("id").alias("v")))
    rows = rows.join(spark.createDataFrame(drawn(), "t bigint, v bigint, id string, timestamp string, pid bigint, bytes bigint"), ["t", "v"])
    rows = rows.withColumns({
        "technique": pick(TECHNIQUES, t),
        "user": F.when(~odd, "NT AUTHORITY\\SYSTEM").otherwise(F.concat(F.lit("CONTOSO\\analyst"), v.cast("string"))),
        "machine": F.concat(F.lit("WKSTN-"), F.lpad((v + 1).cast("string"), 2, "0")),
        "process": F.when(v == 4, "svchost.exe").otherwise(pick(PROCESSES, t)),
        "parent_process": pick(PARENTS, t),
        "src_ip": F.when(odd, "198.51.100.42").otherwise("10.0.0.8"),
        "dst_ip": F.when(odd, "203.0.113.77").otherwise("192.168.1.20"),
        "file_path": F.when(v == 4, "C:\\Windows\\System32\\svchost.exe").when(t == 0, "C:\\Windows\\System32\\lsass.exe").when(t == 2, F.concat(users, F.lit("invoice.docm"))).when(t == 3, "C:\\Finance\\quarterly-results.zip").otherwise(F.concat(users, F.lit("payload"), t.cast("string"), F.lit(".exe"))),
        "domain": F.when(t == 2, "login-microsoft.example").otherwise("corp.contoso.example"),
        "file_hash": F.when(v < 2, "a" * 64).otherwise(F.lpad(F.lower(F.hex(t * 10 + v)), 64, "0")),
    })
    line = F.when(t == 0, F.format_string("%s MiniDump target=%s full", "process", "file_path")).when(t == 1, F.format_string("%s remote_exec destination=%s", "process", "dst_ip")).when(t == 2, F.format_string("%s open_attachment=%s sender=%s", "process", "file_path", "domain")).when(t == 3, F.format_string("%s copy source=%s destination=%s", "process", "file_path", "dst_ip")).when(t == 4, F.format_string("%s elevation=/high", "process")).otherwise(F.format_string("%s delete_shadows=/all,/quiet", "process"))
    links = F.array(F.format_string("%s spawned %s", "parent_process", "process"), F.format_string("%s connected to destination", "process"))
    return rows.withColumn("command_line", line).withColumn("relationships", links).drop("t", "v")


def threshold_pairs(spark: SparkSession, count: int, nodes: int, first: int = 0) -> DataFrame:
    """alert, node, feature, value, threshold: formulas over a grid of alerts and nodes."""
    grid = spark.range(first, first + count).select(F.col("id").alias("alert")).crossJoin(F.broadcast(spark.range(nodes).select(F.col("id").alias("node"))))
    grid = grid.withColumn("feature", ((17 * F.col("alert") + 13 * F.col("node")) % 50).cast("int"))
    return grid.withColumn("value", ((31 * F.col("alert") + 7 * F.col("feature")) % 101).cast("int")).withColumn("threshold", ((19 * F.col("node") + 23) % 101).cast("int"))


def read_cache(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON cache, and the lines that could not be read, which the caller can count. A folder that is not there is an empty cache."""
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    parsed = F.from_json("value", StructType([*schema, StructField("_corrupt", StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})
    lines = text.select("value", parsed.alias("r"))
    return lines.where("r._corrupt is null").select("r.*").drop("_corrupt"), lines.where("r._corrupt is not null").select(F.col("value").alias("line"))


def append_cache(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def as_json(df: DataFrame, label: str | None = None) -> DataFrame:
    """One JSON text a row; a label column never gets into it."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c != label])).alias("json"))


def as_lines(df: DataFrame) -> DataFrame:
    """key=value text a row."""
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]).alias("line"))


def as_markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table; more than `most` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cells = [df.columns, ["---"] * len(df.columns), *[["—" if x is None else str(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells)
