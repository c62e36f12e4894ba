"""Exact deduplication, mixing and sharding, each against a brute-force version."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.llm import exact_dedup, mixing, shared, sharding

LOW = str.maketrans(shared.UPPER, shared.LOWER)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def dedup_truth(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(LOW)].append(d)
    found = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        found += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(found)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda t: F.substring(exact_dedup.sha256_of(t), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(odd, digest):
    found = exact_dedup.groups(odd, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(rows_of(found)) == dedup_truth(rows_of(odd.select("doc_id", "text")))


def test_exact_dedup_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("other "), (F.col("id") % 700).cast("string"))).alias("text"))
    found = exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(rows_of(found)) == dedup_truth(rows_of(docs))


def test_state_goes_on(spark, tmp_path):
    """New arrivals meet the state of earlier runs."""
    home = f"file://{tmp_path}"
    for ids in ([(1, "a"), (2, "b")], [(5, "a"), (3, "b"), (4, "c")]):
        spark.createDataFrame(ids, "doc_id bigint, digest string").coalesce(1).write.mode("append").parquet(f"{home}/in")
        exact_dedup.absorb(spark, f"{home}/in", f"{home}/state", f"{home}/out")
    assert sorted(rows_of(exact_dedup.known(spark, f"{home}/out"))) == [("a", 5, 2), ("b", 3, 2), ("c", 4, 1)]


def test_sieve_lets_all_wanted_pass(spark):
    rows = spark.range(20_000).withColumn("k", F.md5(F.col("id").cast("string")))
    wanted = rows.where("id % 41 = 0").select("k")
    passed = shared.sieve(rows, "k", wanted)
    assert passed.join(wanted, "k").count() == wanted.count() and passed.count() < 2 * wanted.count()


def test_prefix_sums(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("h", F.xxhash64("id") % 97).withColumn("b", F.floor(F.col("h") / 10))
    found = shared.prefix_sums(rows, ["g"], "b", [F.col("h"), F.col("id")], F.col("id"), "s").collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: (r.h, r.id)):
            assert r.s == total
            total += r.id
        assert {r.s_total for r in found if r.g == g} == {total}


def test_sharding(odd):
    found = sharding.interleaved(odd, shards=5)
    got = found.collect()
    docs = rows_of(odd.select("doc_id", "text"))
    assert len(got) == len(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(5))
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for key, total in Counter(r.source_key for r in got).items():
        for s in counts:
            share = sum(r.source_key == key and r.shard == s for r in got)
            assert abs(share - total * counts[s] / len(got)) <= 2


def level(sizes, weights, total, most):
    """Shares by weight, with the excess over most * size shared again among the rest, until none is above."""
    open_, target = dict(zip(sizes, weights, strict=True)), {}
    left = total
    while open_:
        unit = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * unit > most * sizes[s]]
        if not over:
            return target | {s: w * unit for s, w in open_.items()}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del open_[s]
    return target


def test_mixing(odd):
    documents, pieces = mixing.mix(odd, block=64)
    got = documents.collect()
    text = Counter((d, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for d, t in rows_of(odd.select("doc_id", "text")))
    assert Counter((r.doc_id, r.size) for r in got) == text
    sizes = {}
    for k in sorted({r.source_key for r in got}):
        sizes[k] = sum(r.size for r in got if r.source_key == k)
    truth = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes.values()), 2)
    for k, size in sizes.items():
        mine = [r for r in got if r.source_key == k]
        assert {r.source_size for r in mine} == {size} and all(abs(r.target - truth[k]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - truth[k]) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    # Slots are in blocks of equal words and the first slots keep the proportions.
    by_slot = Counter()
    for p in pieces.collect():
        by_slot[p.slot] += p.words
    assert max(by_slot.values()) <= 64


def test_mixing_is_the_same_again(odd):
    one, two = (Counter(rows_of(mixing.mix(odd)[0].select("doc_id", "size", "target", "taken"))) for _ in range(2))
    assert one == two


def test_mixing_is_planned_in_steps(odd):
    """The driver plans passes and schedule apart: what is left to read holds no window, and pieces name their documents without another join."""
    documents, pieces = mixing.mix(odd.withColumn("doc_id", F.monotonically_increasing_id()), block=64)
    assert not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in (documents, pieces))
    of = dict(rows_of(documents.select("row_id", "doc_id")))
    found = pieces.collect()
    assert found and all(of[p.row_id] == p.doc_id for p in found)


def test_schedule_is_of_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", 7000), ("b", 2000), ("c", 1000)], "source_key string, take bigint")
    slots = [r.source_key for r in mixing.schedule(sources, 10).orderBy("slot").collect()]
    assert Counter(slots) == {"a": 700, "b": 200, "c": 100}
    seen = Counter()
    for i, s in enumerate(slots[:900], 1):
        seen[s] += 1
        assert all(abs(seen[k] - i * w) <= 4 for k, w in (("a", 0.7), ("b", 0.2), ("c", 0.1)))


def test_empty(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert sharding.interleaved(empty).count() == 0
    assert mixing.mix(empty)[0].count() == 0
