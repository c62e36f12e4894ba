"""What the operators of this subpackage share: written intermediate tables, and ranks or running sums that no single task has to hold."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as the contracts of the operators define it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, a temporary folder is set on a local master (tests on one machine); a cluster without it is an error, since its executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str, largest: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it is computed once, and a lost executor costs no more than the tasks that read it. The result knows how many `rows` it has and, for the column `largest`, the largest value (0 without rows), counted while it was written."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.col(largest) if largest else F.lit(None).cast("bigint")).alias("largest")).write.parquet(path)
    found = owned(df.sparkSession.read.schema(df.schema).parquet(path), path)
    found.rows = seen.get["rows"]
    found.largest = (seen.get["largest"] or 0) if largest else None
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def owned(df: DataFrame, path: str) -> DataFrame:
    """df, read from `path`, which the scratch() around, if there is one, then answers for."""
    df.kept_at, df.stays = path, False
    own = _OWN.get()
    if own is not None:
        own.append(df)
    return df


#: What keep() wrote within the innermost scratch().
_OWN: ContextVar[list[DataFrame] | None] = ContextVar("own", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Within it, what keep() writes is forgotten at the end, but for what has been told to stay(), which an outer scratch() then owns."""
    own: list[DataFrame] = []
    before = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(before)
        outer, gone = _OWN.get(), [df for df in own if not df.stays]
        for df in own:
            if df.stays and outer is not None:
                df.stays = False  # the outer one decides anew
                outer.append(df)
        forget(*gone)


def stay(df: DataFrame) -> DataFrame:
    """df, which is still read after the scratch() it was written in."""
    df.stays = True
    return df


def forget(*kept: DataFrame) -> None:
    """Deletes what keep() wrote, only for tables that no frame still to be read depends on, and lets the driver collect what it held of their plans and broadcasts."""
    for df in kept:
        remove(df.sparkSession, df.kept_at)
    if kept:
        tidy(kept[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, since Spark's cleaner only releases plans and broadcasts when Java does, and hand what Java's own parts have freed back to the system, where it can (HotSpot on Linux): compilers and hundreds of short-lived threads leave the C library with some 200 MB that it would keep."""
    gc.collect()
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    command = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), TRIM
    try:  # an expression, as the server's class is closed to calls from outside
        jvm.java.beans.Expression(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), "invoke", command).getValue()
    except (Py4JError, TypeError):  # another Java or system has no such command
        pass


#: Java's command that returns freed native memory.
TRIM = "systemTrimNativeHeap"


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; null counts as empty. lower() has a fast path for ASCII, where it does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffled_by(*parts: Column) -> Column:
    """60 bits that look random, the same on every run: the order of a seeded shuffle."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shuffled_by_sql(*parts: str) -> str:
    """shuffled_by for DuckDB."""
    text = " || ':' || ".join(f"coalesce(({p})::varchar, 'null')" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def source_key(source: Column) -> Column:
    """A non-null key that sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))


def buckets_for(rows: int) -> int:
    """Bits of a 60-bit hash that deal so many rows into about as many buckets as a bucket has rows, the square root of them: neither a bucket nor the list of all buckets is much for one task at any number of rows."""
    return max(1, math.ceil(math.log2(max(2, rows)) / 2))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of `weight` over the rows that come before in the group, and `out`_total, the group's sum.

    `bucket` must be a column whose order agrees with `order`. Sums are taken for each bucket, run up over the (few) buckets of a group, and only then over the rows of one bucket, so that a group with a third of all rows is spread over as many tasks as it has buckets.
    """
    df = df.withColumn("__w", weight)
    sums = df.groupBy(*group, bucket).agg(F.sum("__w").alias("__s"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.select(*group, bucket, F.coalesce(F.sum("__s").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(over).alias(f"{out}_total"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__in", F.coalesce(F.sum("__w").over(inner), F.lit(0))).join(sums, [*group, bucket]).withColumn(out, F.col("__before") + F.col("__in")).drop("__w", "__in", "__before")


#: Rows of a bitmap hold so many bits (2^15, 4 KB); a broadcast bitmap has at most so many (2^28, 32 MB).
CHUNK_BITS, MOST_BITS = 15, 28


def bitmap(at: DataFrame) -> DataFrame:
    """From rows (__at), numbers of bits: __chunk, __bits, one row for each 2^15 bits that has any set."""
    return at.groupBy(F.shiftright("__at", CHUNK_BITS).alias("__chunk")).agg(F.bitmap_construct_agg(F.col("__at").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))).alias("__bits"))


def set_in(bits: str = "__bits", at: str = "__at") -> Column:
    """Whether the bit is set in its row of the bitmap."""
    byte = f"cast(conv(hex(substring({bits}, cast(({at} & {(1 << CHUNK_BITS) - 1}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"shiftright({byte}, cast({at} & 7 as int)) & 1 = 1")


def count_of(df: DataFrame) -> int:
    """How many rows there are; keep() has counted them already."""
    known = df.__dict__.get("rows")
    return df.count() if known is None else known


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among those of `wanted`, and about one in sixteen others, before anything is shuffled; an exact join must follow.

    The keys wanted are counted and hashed into a bitmap of 16 to 32 bits a key, which is built by an aggregation and broadcast. It has at most 2^MOST_BITS bits (32 MB, a proven bound); of more keys, each range of hashes gets a bitmap and a pass over the rows of its own, so that as few others pass at any number of keys.
    """
    bits = max(20, math.ceil(math.log2(16 * max(1, count_of(wanted)))))
    ranges = 1 << max(0, bits - MOST_BITS)
    bits = min(bits, MOST_BITS)
    names, found = rows.columns, None

    def placed(df):  # the lowest bits of the hash choose the range, the highest the bit
        h = F.xxhash64(F.col(key))
        return df.withColumns({"__range": h.bitwiseAND(F.lit(ranges - 1)), "__at": F.shiftrightunsigned(h, 64 - bits)})

    for i in range(ranges):
        mine, some = (placed(df) for df in (rows, wanted.select(key)))
        if ranges > 1:
            mine, some = mine.where(F.col("__range") == i), some.where(F.col("__range") == i)
        mine = mine.withColumn("__chunk", F.shiftright("__at", CHUNK_BITS))
        passed = mine.join(F.broadcast(bitmap(some.select("__at"))), "__chunk").where(set_in()).select(*names)
        found = passed if found is None else found.unionByName(passed)
    return found


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Names of Spark's part files: the task's number, and the file's number within the task.
_PART = r"^part-(\d{1,6})(?:-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})?(?:-c(\d{1,3}))?(?:\.[a-z0-9]+)?\.parquet$"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row that every read of the result finds again, whatever the executors: from the number of the file that Spark wrote and the row's place in it. Rows that do not come straight from such files, each with a number of its own, are written first."""
    plan = df._jdf.queryExecution().analyzed()
    files = [f.rsplit("/", 1)[-1] for f in df.inputFiles()] if plan.getClass().getSimpleName() == "LogicalRelation" else []
    found = [re.match(_PART, f) for f in files]
    if not found or not all(found) or len({(int(m[1]), int(m[2] or 0)) for m in found}) < len(found):
        df = stay(keep(df, "numbered"))
    meta = df.metadataColumn("_metadata")
    part, more = (F.coalesce(F.regexp_extract(meta["file_name"], _PART, i).try_cast("bigint"), F.lit(0)) for i in (1, 2))
    return df.withColumn(name, part * F.lit(1 << 42) + more * F.lit(1 << 32) + meta["row_index"])


def picked(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """The rows of a numbered() table whose number is among those of `wanted` (one column, `number`). Numbers are dense in each file, so an exact bitmap has about a bit a row; up to 2^MOST_BITS of them (32 MB) are broadcast and the rows stay where they are, more are joined by a shuffle."""
    at = wanted.select(F.col(number).alias("__at"))
    bits = stay(keep(bitmap(at), "picked"))
    if bits.rows << CHUNK_BITS <= 1 << MOST_BITS:
        bits = F.broadcast(bits)
        placed = rows.withColumns({"__at": F.col(number), "__chunk": F.shiftright(F.col(number), CHUNK_BITS)})
        return placed.join(bits, "__chunk").where(set_in()).select(*rows.columns)
    return rows.join(wanted.select(number).distinct(), number, "left_semi").select(*rows.columns)


#: By the pigeonhole principle fewer than so many keys hold more than one row in so many: what is broadcast for them is bounded.
HOT_KEYS, HOT_ROWS = 20_000, 64


def joined_to_few(rows: DataFrame, keys: list[str], side: DataFrame, size: str, total: int) -> DataFrame:
    """rows joined to `side`, which has one row for each key and in column `size` the number of rows with the key, of `total` in all. Keys with more than total / HOT_KEYS rows are broadcast (fewer than HOT_KEYS), so no task gets all rows of a hot key; the others are joined by a shuffle. side should be kept, as it is read twice; where keep() has seen that no key is hot, nothing is broadcast. Key columns are not null."""
    bound = max(HOT_ROWS, total // HOT_KEYS)
    most = side.__dict__.get("largest")
    if most is not None and most <= bound:
        return rows.join(side, keys).select(*rows.columns, *[c for c in side.columns if c not in keys])
    more = [c for c in side.columns if c not in keys]
    few = side.where(F.col(size) > bound).withColumnRenamed(size, "__hot").select(*keys, F.lit(True).alias("__is"), *[F.col("__hot" if c == size else c).alias(f"__{c}") for c in more])
    looked = rows.join(F.broadcast(few), keys, "left")
    hot = looked.where(F.col("__is")).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in more])
    cold = looked.where(F.col("__is").isNull()).select(*rows.columns).join(side.where(F.col(size) <= bound), keys)
    return hot.unionByName(cold.select(*rows.columns, *more))


def first_by_hash(rows: DataFrame, order: list[Column], most: int, once: bool = False, where: Column | None = None) -> DataFrame:
    """The first `most` rows in the order of a 60-bit hash (the first of `order`; the others break ties). Rows are counted, and only hashes below a bound, which lets about twice as many pass as wanted, are sorted; where equal hashes leave too few, the bound is widened. The result is written, so the driver gets no more than `most` rows, however many partitions there are. once: of equal rows one. where: a condition on rows, looked at only below the bound."""
    total, spark = rows.count(), rows.sparkSession
    if not total:
        return spark.createDataFrame([], rows.schema)
    bound = min(1 << 60, (1 << 60) * (2 * most + 1000) // total)
    while True:
        some = rows.where(order[0] < bound)
        some = some if where is None else some.where(where)
        found = keep((some.distinct() if once else some).orderBy(*order).limit(most), "first")
        if bound >= 1 << 60 or found.rows >= min(most, total):
            return found
        forget(found)
        bound = min(1 << 60, bound * 16)
