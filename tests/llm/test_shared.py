"""What the operators share: numbered rows, exact picks, bounded samples, joins with hot keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from hushframe.llm import shared


def test_numbers_stay_and_differ(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.range(5000).withColumn("__row", F.lit("mine")).repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    name = shared.free(docs, "__row")
    assert name != "__row"
    one, two = ({(r[name], r.id) for r in shared.numbered(docs, name).select(name, "id").collect()} for _ in range(2))
    assert one == two and len({n for n, _ in one}) == 5000
    with_filter = shared.numbered(docs.where("id < 100").unionByName(docs.where("id < 50")), name)
    assert with_filter.count() == 150 == with_filter.select(name).distinct().count()
    assert shared.numbered(docs.where("false"), name).count() == 0


@pytest.mark.parametrize("bits", [shared.MOST_BITS, shared.CHUNK_BITS - 1], ids=["bitmap", "shuffle"])
def test_picked_rows_are_those_wanted(spark, monkeypatch, bits):
    monkeypatch.setattr(shared, "MOST_BITS", bits)
    docs = shared.numbered(spark.range(40_000).repartition(3), "n")
    wanted = docs.where("id % 3 = 1").select("n")
    assert sorted(r.id for r in shared.picked(docs, "n", wanted).collect()) == list(range(1, 40_000, 3))
    assert shared.picked(docs, "n", wanted.where("false")).count() == 0


@pytest.mark.parametrize("most_bits", [28, 16])
def test_sieve_over_ranges(spark, monkeypatch, most_bits):
    monkeypatch.setattr(shared, "MOST_BITS", most_bits)
    rows = spark.range(20_000).withColumn("k", F.md5(F.col("id").cast("string")))
    wanted = rows.where("id % 5 = 0").select("k")
    passed = shared.sieve(rows, "k", wanted)
    assert passed.join(wanted, "k").count() == 4000 and passed.count() < 6500 and passed.select("id").distinct().count() == passed.count()


@pytest.mark.parametrize("ids", [1, 5, None])
def test_sample_of_repeated_identifiers(spark, ids):
    rows = spark.range(200_000).select((F.col("id") % ids if ids else F.lit(None)).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("text"))
    order = [shared.shuffled_by(F.lit(7), F.col("doc_id")), F.col("text")]
    assert shared.first_by_hash(rows, order, 300).count() == 300
    assert shared.first_by_hash(rows.limit(20), order, 300).count() == 20
    assert shared.first_by_hash(rows.where("false"), order, 300).count() == 0


def test_joined_to_few_is_a_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    side = shared.keep(rows.where("k <> 7").groupBy("k").agg(F.count("id").alias("n"), F.min("id").alias("low")), "side")
    found = Counter(map(tuple, shared.joined_to_few(rows, ["k"], side, "n", 3000).select("k", "id", "n", "low").collect()))
    assert found == Counter(map(tuple, rows.join(side, "k").select("k", "id", "n", "low").collect()))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://far:7077"
        getConf = Conf

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_forgotten_tables_are_gone(spark):
    kept = shared.keep(spark.range(3), "gone")
    shared.forget(kept)
    with pytest.raises(Exception, match="(?i)not.?found|does not exist"):
        spark.read.parquet(kept.kept_at).count()
