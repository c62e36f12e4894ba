"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source gets words in proportion to its weight, but no more than `most` times its size; what is cut off goes to the others by weight (the water level below). Slots: slot i of the schedule is the point (i G mod 2^31) / 2^31, G odd and near 2^31 divided by the golden ratio, and belongs to the source in whose stretch of the cumulative shares the point falls; slots of a source are ranked, and its rank r takes block r of the source. Blocks: the words of a source, its documents in seeded shuffled order, once for each pass and each pass in another order, are cut into blocks of equal words. After the slots that the shares ask for, a source that is still short of its target by some blocks gets them at the end, and the last block of a source is cut at its target, so taken words meet the rounded target.

Cases: a null or empty text has no words and is never taken; a very long text is taken in as many blocks as it reaches into; a null source is a source of its own, the last; a table without words takes nothing; repeated rows are documents of their own; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, buckets_for, keep, prefix_sums, shuffled_by, shuffled_by_sql, source_key, tidy

WEIGHTS, SHARE, MOST, BLOCK, SEED = (5, 2, 1), 1.5, 2, 2048, 4
#: 2^31 divided by the golden ratio, made odd, so that i -> i G mod 2^31 meets each of the 2^31 points once.
PERIOD, GOLDEN = 1 << 31, 1327217885
BINS = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source_key, size) rows: source_key, source_size, weight, target, take. Sources are few; one row each reaches the windows over all of them."""
    by = Window.orderBy("source_key")
    s = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (((F.row_number().over(by) - 1) % len(weights)) + 1).cast("int")).cast("bigint"))
    ratio = (F.lit(most) * F.col("source_size")) / F.col("weight")
    fill = Window.orderBy("ratio", "source_key")
    s = s.withColumn("ratio", ratio).withColumns({
        "full": F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy(F.lit(1))),
    })
    s = s.withColumn("level", (F.lit(share) * F.col("total") - F.col("full")) / F.col("open"))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy(F.lit(1))))
    s = s.withColumn("target", F.least((F.lit(most) * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    return s.select("source_key", "source_size", "weight", "target", F.floor(F.col("target") + 0.5).alias("take"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_key, block: the order in which blocks are taken. Reads the number of slots, one value."""
    quota = sources.withColumn("quota", F.expr(f"(take + {block - 1}) div {block}"))
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    up = Window.orderBy("source_key")
    share = quota.withColumn("low", F.coalesce(F.sum("quota").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("high", F.col("low") + F.col("quota"))
    for c in ("low", "high"):
        share = share.withColumn(c, F.floor(F.col(c) / F.lit(max(1, total)) * F.lit(PERIOD)))
    share = share.where("quota > 0").select("source_key", "quota", "low", "high")
    width = PERIOD // BINS
    bins = share.where("high > low").withColumn("bin", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    spark = sources.sparkSession
    point = f"(((id + 1) % {PERIOD}) * {GOLDEN}) % {PERIOD}"
    slots = spark.range(total).selectExpr("id as slot", f"{point} as point").withColumn("bin", F.expr(f"point div {width}"))
    slots = slots.join(bins, "bin").where("point >= low and point < high").select("slot", "source_key", "quota")
    slots = slots.withColumn("chunk", F.shiftright("slot", buckets_for(total)))
    ranked = prefix_sums(slots, ["source_key"], "chunk", [F.col("slot")], F.lit(1), "block")
    drawn = ranked.where("block < quota").select("slot", "source_key", "block")
    have = ranked.groupBy("source_key").agg(F.count(F.lit(1)).alias("have"))
    short = share.join(have, "source_key", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
    tail = short.select("source_key", F.explode(F.sequence("have", F.col("quota") - 1)).alias("block")).select((F.lit(total) + F.col("block")).alias("slot"), "source_key", "block")
    return drawn.unionByName(tail)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Two tables. documents: row_id, doc_id, source_key, size, source_size, target, taken, first_slot (the earliest slot that takes words of the document; null if none does). pieces: row_id, doc_id, pass, slot, start, words: the stretch of the document's words that the slot takes. The stretches of the passes and the schedule are written on the way, so the driver never plans all of it at once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("source_key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    base = keep(base.withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")
    sources = keep(targets(base, weights, share, most), "mix-targets")
    bits = buckets_for(base.rows)
    runs = base.where("size > 0").join(sources.select("source_key", "source_size", "take"), "source_key")
    runs = runs.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(most)]))).withColumn("h", shuffled_by(F.lit(seed), F.col("pass"), F.col("doc_id")))
    runs = runs.withColumn("hb", F.col("pass").cast("bigint") * (1 << bits) + F.shiftright("h", 60 - bits))
    runs = prefix_sums(runs, ["source_key"], "hb", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("row_id")], F.col("size"), "start").where("start < take")
    runs = keep(runs.select("row_id", "doc_id", "source_key", "pass", "start", F.least(F.col("start") + F.col("size"), F.col("take")).alias("end")), "mix-runs")
    slots = keep(schedule(sources, block), "mix-slots")
    tidy(docs.sparkSession)
    parts = runs.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    parts = parts.join(slots, ["source_key", "block"])
    low = F.greatest(F.col("start"), F.col("block") * block)
    pieces = parts.select("row_id", "doc_id", "pass", "slot", (low - F.col("start")).alias("start"), (F.least(F.col("end"), (F.col("block") + 1) * block) - low).alias("words"))
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    documents = base.join(sources.select("source_key", "source_size", "target"), "source_key").join(taken, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return documents, pieces


def op4_golden_ratio_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def _pass_sql(n: int) -> str:
    h = shuffled_by_sql(str(SEED), str(n), "doc_id")
    return f"""select r, k, source_size * {n} + sum(size) over (partition by k order by {h}, doc_id, size, r rows unbounded preceding) - size as start, size, take from sized"""


ORACLE = {
    "op4_golden_ratio_mix": f"""
with words as (select doc_id, coalesce('s' || source, 'z') as k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, row_number() over () as r from documents),
sources as (select k, sum(size)::bigint as source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by k) - 1) % {len(WEIGHTS)} + 1)::int]::bigint as weight from words group by k),
ratios as (select *, ({MOST} * source_size)::double / weight as ratio, sum(source_size) over () as total from sources),
levels as (select *, ({SHARE}::double * total::double - coalesce(sum({MOST} * source_size) over (order by ratio, k rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(weight) over (order by ratio, k rows between current row and unbounded following))::double as level from ratios),
targets as (select k, source_size, least(({MOST} * source_size)::double, weight * (select level from levels where level <= ratio order by ratio, k limit 1)) as target from levels),
sized as (select words.*, source_size, target, floor(target + 0.5)::bigint as take from words join targets using (k)),
passes as ({" union all ".join(_pass_sql(n) for n in range(MOST))}),
takes as (select r, sum(greatest(0, least(start + size, take) - start))::bigint as taken from passes group by r),
quotas as (select distinct k, (take + {BLOCK - 1}) // {BLOCK} as quota from sized),
stretches as (select k, quota, sum(quota) over () as total, sum(quota) over (order by k) as high from quotas),
shares as (select k, quota, total, floor((high - quota)::double / greatest(1, total)::double * {PERIOD}::double)::bigint as low, floor(high::double / greatest(1, total)::double * {PERIOD}::double)::bigint as high from stretches where quota > 0),
points as (select i as slot, ((i + 1) % {PERIOD}) * {GOLDEN} % {PERIOD} as point from range((select coalesce(sum(quota), 0)::bigint from quotas)) t(i)),
ranked as (select slot, k, quota, row_number() over (partition by k order by slot) - 1 as block from points join shares on point >= low and point < high),
short as (select shares.k, total, shares.quota, count(slot) as have from shares left join ranked using (k) group by shares.k, total, shares.quota),
slots as (select slot, k, block from ranked where block < quota union all select total::bigint + block, k, block from (select k, total, unnest(range(have, quota::bigint)) as block from short where have < quota)),
parts as (select r, k, unnest(range(start::bigint // {BLOCK}, (least(start + size, take)::bigint - 1) // {BLOCK} + 1)) as block from passes where size > 0 and start < take),
firsts as (select r, min(slot)::bigint as first_slot from parts join slots using (k, block) group by r)
select doc_id, size, source_size, target, taken, first_slot from sized join takes using (r) left join firsts using (r)""",
}
