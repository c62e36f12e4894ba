"""Proportional stratified interleaving.

Rows are shuffled by a seed and ranked within their source. A row's fractional rank (2 rank + 1) / (2 rows of its source) says where it stands in any mixture that keeps to the proportions; sorted by it, each stretch of the order holds the sources in proportion, and cutting the order into equal stretches gives shards whose row counts are at most one apart and whose sources differ from the mixture by about one row each.

Cases: a null text has no bytes and size 8; a null source is a source of its own, the last; rows that agree in all columns stand next to each other in either order; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buckets_for, prefix_sums, shuffled_by, shuffled_by_sql, source_key

SHARDS, SEED = 24, 20


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source_key, position (in the whole order), shard, slot: one row for each row of docs."""
    text = F.col(text_col)
    rows = docs.count()
    bits = buckets_for(rows)
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        source_key(F.col(source_col)).alias("source_key"), shuffled_by(F.lit(seed), F.col(id_col)).alias("h"),
    )
    tie = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    base = prefix_sums(base.withColumn("hb", F.shiftright("h", 60 - bits)), ["source_key"], "hb", tie, F.lit(1), "rank")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("rank_total"))
    base = base.drop("hb").withColumn("fraction", fraction).withColumn("fb", F.floor(F.col("fraction") * F.lit(1 << bits)))
    base = prefix_sums(base, [], "fb", [F.col("fraction"), F.col("source_key"), *tie], F.lit(1), "position")
    base = base.withColumn("shard", F.expr(f"(position * {shards}) div position_total").cast("int"))
    return base.withColumn("slot", F.expr(f"position - (shard * position_total + {shards - 1}) div {shards}")).drop("h", "rank", "rank_total", "fraction", "fb", "position_total")


def op10_stratified_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleaved(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a list of half bytes, each byte's low half first: entry n of the table is n after four steps of the reflected polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, halves), lambda a, x: xor(a >> 4, list_extract({table}, (xor(a, x) & 15) + 1))), 4294967295::bigint)"
_HALVES = """list_transform(range(1, len(digits) + 1), lambda i: (strpos('0123456789ABCDEF', digits[i + 2 * (i % 2) - 1]) - 1)::bigint)"""


def _nibble_table() -> list[int]:
    found = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        found.append(n)
    return found


ORACLE = {
    "op10_stratified_shards": f"""
with split as (select *, case when coalesce(text, '') = '' then [] else string_split(hex(text), '') end as digits from documents),
parts as (select *, {_HALVES} as halves from split),
base as (select doc_id, (coalesce(strlen(text), 0) + 8)::bigint as size, coalesce('s' || source, 'z') as k,
    {_CRC.format(table=f"{_nibble_table()}::bigint[]")}::bigint as text_crc32, {shuffled_by_sql(str(SEED), "doc_id")} as h from parts),
ranked as (select *, row_number() over (partition by k order by h, doc_id, text_crc32, size) - 1 as r, count(*) over (partition by k) as n from base),
placed as (select *, row_number() over (order by (2 * r + 1)::double / (2 * n), k, h, doc_id, text_crc32, size) - 1 as p, count(*) over () as total from ranked)
select doc_id, size, text_crc32, 'rows' as law, ((p * {SHARDS}) // total)::int as shard,
    (p - (((p * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS})::bigint as slot, null::int as grown_shard from placed""",
}
