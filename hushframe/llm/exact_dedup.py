"""Exact deduplication over a stream with keyed state.

Documents arrive as a stream of (digest, identifier). A Structured Streaming aggregation keyed by the digest keeps, in RocksDB on the executors' disks, one small row for each digest: the largest identifier, which also locates the content, and the number of arrivals. There is no watermark, so the state never expires, and a restart with the same state folder goes on from it. Texts never enter the state.

A digest that occurs twice is a hit, not yet a copy: the texts of hits are compared byte for byte, by grouping them by digest and whole text, where each task first puts equal texts of its own rows together, so a text with a third of all rows leaves a task once. A digest with several texts (a collision) is split by whole text, so the result is exact for any digest. Where rows look up their digest in the state, hot digests are broadcast (shared.joined_to_few), so none is one task's work.

Cases: null counts as empty text, and all empty texts are equal; a very long text is hashed and compared whole; rows that agree in identifier and text are copies of each other and share one fate; a null identifier never stays if a copy has one; an empty table gives no rows; other columns of the input are ignored, but for those to carry, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, joined_to_few, keep, lowered, new_path, owned, remove, scratch, sieve, stay

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition sets several MB of disk aside
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def with_settings(spark: SparkSession, values: dict[str, str]) -> SparkSession:
    """A session with spark's settings and these, so that no other query of spark sees them."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in values.items():
        session.conf.set(k, v)
    return session


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def absorb(spark: SparkSession, arrivals: str, state: str, out: str) -> None:
    """Runs all new files of the folder `arrivals` (doc_id, digest) through the state in `state`; what changed in a run goes to `out`/batch=n. A batch that is run again replaces its own folder."""
    stream = with_settings(spark, STATE).readStream.schema("doc_id bigint, digest string").parquet(arrivals)
    seen = stream.groupBy("digest").agg(F.max("doc_id").alias("locator"), F.count(F.lit(1)).alias("arrivals"))
    query = seen.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()


def known(spark: SparkSession, out: str) -> DataFrame:
    """digest, locator, arrivals: the state as the last change left it."""
    changes = spark.read.schema("digest string, locator bigint, arrivals bigint, batch bigint").parquet(out)
    return changes.groupBy("digest").agg(F.max_by(F.struct("locator", "arrivals"), "batch").alias("s")).select("digest", "s.*")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, carry: str | None = None) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept: one row for each row of docs. carry: a numeric column of docs that goes with them."""
    spark = docs.sparkSession
    home = new_path(spark, "dedup")
    with scratch():
        more = [carry] if carry else []
        texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lowered(F.col(text_col)).alias("norm"), *more)
        own = [] if digest is sha256_of else [sha256_of(F.col("norm")).alias("text_sha256")]
        full = texts.withColumn("digest", digest(F.col("norm")))
        full.select("doc_id", "digest", *own, *more).write.parquet(f"{home}/arrivals")
        arrived = stay(owned(spark.read.parquet(f"{home}/arrivals"), home))
        if digest is sha256_of:
            arrived = arrived.withColumn("text_sha256", F.col("digest"))
        absorb(spark, f"{home}/arrivals", f"{home}/state", f"{home}/changes")
        state = stay(keep(known(spark, f"{home}/changes"), "dedup-known", largest="arrivals"))
        for folder in ("state", "changes"):
            remove(spark, f"{home}/{folder}")
        total = arrived.count()

        # Hits alone bring their texts, one for each distinct text and task.
        met = sieve(full.select("doc_id", "norm", "digest"), "digest", state.where("arrivals > 1").select("digest"))
        met = met.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        kinds = keep(met.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "dedup-collided")
        whole = arrived.select("doc_id", "digest", "text_sha256", *more)
        if not kinds.rows:
            found = joined_to_few(whole, ["digest"], state, "arrivals", total)
            found = found.select("doc_id", "text_sha256", F.col("locator").alias("keep_id"), F.col("arrivals").alias("group_size"), *more)
        else:  # texts themselves decide within such digests
            stay(kinds)
            apart = full.join(kinds.select("digest"), "digest").select("doc_id", "digest", "norm", *more)
            each = stay(keep(apart.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-texts"))
            apart = apart.join(each, ["digest", "norm"]).select("doc_id", sha256_of(F.col("norm")).alias("text_sha256"), "keep_id", "group_size", *more)
            single = joined_to_few(whole.join(kinds.select("digest"), "digest", "left_anti"), ["digest"], state, "arrivals", total)
            found = single.select("doc_id", "text_sha256", F.col("locator").alias("keep_id"), F.col("arrivals").alias("group_size"), *more).unionByName(apart)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_NORM = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLE = {
    "op9_exact_dedup": f"""
with t as (select doc_id, sha256({_NORM}) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    doc_id is not distinct from max(doc_id) over (partition by text_sha256) as kept, text_sha256 from t""",
}
