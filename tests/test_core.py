"""Functions, operators and sources on fixtures."""

import hashlib
import hmac
import secrets

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe import streaming
from hushframe.functions import predicates as P
from hushframe.functions import text as X
from hushframe.functions import tokens as T
from hushframe.operators import compare, crypto, leakage, pseudonymize, scoring, validate
from hushframe.plans import queries as Q
from hushframe.sources import prng, tables


def values(df):
    return [tuple(r) for r in df.collect()]


def test_token_is_an_hmac(spark):
    rows = spark.createDataFrame([("alice",), ("ä\\b",), ("",), (None,)], "v string")
    got = [r[0] for r in rows.select(T.token("user", F.col("v"))).collect()]
    for v, t in zip(["alice", "ä\\b", ""], got, strict=False):
        assert t == "tok_user_" + hmac.new(bytes(range(32)), b"user\0" + v.encode(), "sha256").hexdigest()[:32]
    assert got[3] is None
    other = rows.select(T.token("user", F.col("v"), T.Key.of(b"other"))).first()[0]
    assert other != got[0] and rows.select(T.token("host", F.col("v"))).first()[0][-32:] != got[0][-32:]
    spark.conf.set(T.SETTING, bytes(range(32)).hex())
    assert T.Key.from_session(spark) == T.TEST_KEY


def test_nullifier_is_scoped(spark):
    one = spark.range(1)
    made = {(s, c, e): one.select(T.nullifier(T.binary(s), T.binary(c), F.lit(e))).first()[0] for s in (b"a" * 32, b"b" * 32) for c in (b"c" * 16, b"d" * 16) for e in (7, 8)}
    assert len(set(made.values())) == 8
    assert made[b"a" * 32, b"c" * 16, 7] == hashlib.sha256(T.NULLIFIER_DOMAIN.encode() + b"a" * 32 + b"c" * 16 + (7).to_bytes(8, "big")).hexdigest()


@pytest.mark.parametrize(("ip", "kind"), [("10.1.2.3", "RFC1918"), ("10.zzz", "RFC1918"), ("192.168.0.1", "RFC1918"), ("172.16.0.1", "RFC1918"), ("172.31.9.9", "RFC1918"), ("172.32.0.1", "PUBLIC"), ("172.x.0.1", "PUBLIC"), ("172.", "PUBLIC"), ("172", "PUBLIC"), ("8.8.8.8", "PUBLIC"), ("::1", "PUBLIC"), ("", "PUBLIC"), (None, "PUBLIC")])
def test_ip_class(spark, ip, kind):
    assert spark.createDataFrame([(ip,)], "v string").select(P.ip_class(F.col("v"))).first()[0] == kind


def test_predicates(spark):
    rows = spark.createDataFrame([("C:\\Windows\\CMD.exe",), ("/bin/cmd.exe",), ("cmd.exe\n",), ("a/b\\c",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(P.basename(F.col("v"))).collect()] == ["CMD.exe", "cmd.exe", "cmd.exe\n", "c", "", None]
    assert [r[0] for r in rows.select(P.known(F.col("v"))).collect()] == [True, True, False, False, False, False]
    texts = spark.createDataFrame([("abc",), ("abcd",), ("",), ("ä",), (None,), ("a\n",)], "v string")
    assert [r[0] for r in texts.select(P.text_ok(F.col("v"), 3)).collect()] == [True, False, False, False, False, True]


def plain_replace(text, pairs):
    ordered = sorted([p for p in pairs if p[0]], key=lambda p: -len(p[0].encode()))
    out, at = "", 0
    while at < len(text):
        for k, v in ordered:
            if text.startswith(k, at):
                out, at = out + v, at + len(k)
                break
        else:
            out, at = out + text[at], at + 1
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab.\\E$é(", max_size=25), st.lists(st.tuples(st.text(alphabet="ab.\\E$é(", max_size=4), st.text(alphabet="abxy.$", max_size=4)), max_size=5))
def test_replacement_is_one_pass(spark, text, pairs):
    rows = spark.createDataFrame([(text, pairs)], "t string, p array<struct<k string, v string>>")
    assert rows.select(X.replace_entities(F.col("t"), F.col("p"))).first()[0] == plain_replace(text, pairs)


def test_restore(spark):
    rows = spark.createDataFrame([("x tok_a_1 tok_a_12.", [("tok_a_1", "A"), ("tok_a_12", "B")])], "t string, p array<struct<k string, v string>>")
    assert rows.select(X.restore(F.col("t"), F.col("p"))).first()[0] == "x A B."


def test_sets(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), ([], []), (["a"], ["b"])], "a array<string>, b array<string>")
    assert values(rows.select(X.same_set(F.col("a"), F.col("b")), X.jaccard(F.col("a"), F.col("b")))) == [(True, 1.0), (True, 1.0), (False, 0.0)]


def test_alerts(spark):
    a = tables.alerts(spark).cache()
    rows = {(r.technique, r.machine): r for r in a.collect()}
    assert len(rows) == 30
    first, last = rows["credential_dumping", "WKSTN-01"], rows["ransomware_preparation", "WKSTN-05"]
    assert (first.id, first.timestamp, first.pid, first.bytes) == ("ALRT-107f575b25d06d7e", "2026-01-01T12:28:00Z", 36092, 1075002)
    assert (last.id, last.timestamp, last.pid, last.bytes) == ("ALRT-afbee8840d819303", "2026-01-06T12:35:00Z", 21350, 4922901)
    for mode in pseudonymize.MODES:
        out = {r.id: r for r in pseudonymize.pseudonymized(a, mode).collect()}
        for r in rows.values():
            o = out[r.id]
            assert (o.timestamp, o.pid, o.technique, o.bytes) == (r.timestamp, r.pid, r.technique, r.bytes)
            pairs = [(r[f], o[f]) for f in pseudonymize.FIELDS]
            assert o.command_line == plain_replace(r.command_line, pairs) and o.relationships == [plain_replace(x, pairs) for x in r.relationships]
    with pytest.raises(ValueError):
        pseudonymize.rendered("user", F.col("user"), "other")
    assert "technique" not in tables.as_json(a, "technique").first()[0]


def test_stream_of_draws():
    s = prng.Stream(7, room=16)
    assert [s.u32() for _ in range(40)] == prng.words(7, 48)[:40].tolist()
    s = prng.Stream(9)
    assert [s.below(100) for _ in range(500)] == prng.bounded(9, 100, 500).tolist()


def test_threshold_pairs(spark):
    hits = {5: (3028, 48), 10: (5742, 97), 20: (10294, 196), 50: (24805, 491), 100: (49906, 988)}
    for k, want in hits.items():
        (r,) = scoring.hits(tables.threshold_pairs(spark, 1000, k), []).collect()
        assert (r.n_rows, r.hits, r.ties) == (1000 * k, *want)


def test_validation_order(spark):
    got = {r["name"]: (r["code"], r["message"]) for r in validate.checked(Q.witnesses(spark)).collect()}
    assert got["valid"] == (0, validate.MESSAGES[0]) and got["schema"] == (2, validate.MESSAGES[2]) and got["modulus"][0] == 7 and got["long"][0] == 9
    assert {got[k][0] for k in ("severity", "zero_id", "not_ascii", "early_and_schema", "all")} == {1}
    assert got["schema_and_modulus"][0] == 2 and got["modulus_and_long"][0] == 7


def test_record_bytes_against_struct(spark):
    """Byte for byte, by an encoder of its own."""
    import struct

    def encoded(a):
        out = struct.pack("<H", a.schema_version) + bytes(a.alert_id) + struct.pack("<QBB", a.timestamp, a.severity, a.category)
        for c in ("user", "machine", "process", "ip", "file_path"):
            out += struct.pack("<Q", len(a[c].encode())) + a[c].encode()
        return out

    for r in Q.witnesses(spark).withColumn("raw", validate.alert_bytes(lambda c: F.col("alert")[c])).collect():
        assert bytes(r.raw) == encoded(r.alert)
    key, cipher = bytes(range(33)), bytes(range(256))
    raw = spark.range(1).select(validate.public_bytes(T.binary(cipher), F.lit("ab" * 32), T.binary(key), F.lit("cd" * 32), T.binary(b"c" * 16), F.lit(7), F.lit("ef" * 32))).first()[0]
    assert bytes(raw) == struct.pack("<Q", 256) + cipher + b"\xab" * 32 + struct.pack("<Q", 33) + key + b"\xcd" * 32 + b"c" * 16 + struct.pack("<Q", 7) + b"\xef" * 32 and len(raw) == 425


def test_validation_with_keys(spark):
    secret = 12345
    x, y = crypto.times(secret, crypto.G)
    key = bytes([2 + y % 2]) + x.to_bytes(32, "big")
    good = Q.witnesses(spark).where("name = 'valid'")
    rows = validate.checked(good).withColumn("message", validate.alert_bytes(lambda c: F.col("alert")[c]))
    message = bytes(rows.first()["message"])
    assert len(message) == 143
    n = (1 << 2047) + 9
    seed, sig = bytes(range(32)), crypto.signed(message, secret, 777)
    cipher = crypto.encrypted(message, n, 65537, seed)
    assert cipher == crypto.oaep(message, n, 65537, prng.seeded_bytes(seed, 32))
    flip = lambda b: b[:-1] + bytes([b[-1] ^ 1])
    cases = [(0, 0, key, sig, cipher), (4, 0, b"\x05" + key[1:], sig, cipher), (5, 0, key, bytes(64), cipher), (6, 0, key, flip(sig), cipher), (10, 0, key, sig, flip(cipher)), (4, 7, b"\x05" + key[1:], sig, cipher), (4, 9, b"\x05" + key[1:], sig, cipher), (6, 9, key, flip(sig), cipher), (7, 7, key, sig, flip(cipher)), (9, 9, key, sig, flip(cipher)), (1, 1, b"", b"", b""), (2, 2, b"", b"", b"")]
    df = spark.createDataFrame([(want, code, bytearray(message), bytearray(k), bytearray(s), bytearray(n.to_bytes(256, "big")), bytearray(b"\x01\x00\x01"), bytearray(seed), bytearray(c)) for want, code, k, s, c in cases], "want int, code int, message binary, sensor_public_key binary, sensor_signature binary, recipient_modulus binary, recipient_exponent binary, encryption_seed binary, expected_ciphertext binary")
    assert all(r.want == r.code for r in crypto.completed(df, "message").collect())
    assert crypto.completed(df.where("false"), "message").count() == 0
    with pytest.raises(ValueError):
        crypto.few(crypto.MOST_ROWS + 1)


def test_seeded_bytes_are_chacha20():
    """The published first block for a key of zeros."""
    assert prng.seeded_bytes(bytes(32), 32).hex() == "76b8e0ada0f13d90405d6ae55386bd28bdd219b8a08ded1aa836efcc8b770dc7"


def test_comparison_in_stages():
    k = crypto.keygen(512, 128)
    one, other = crypto.split(k.alpha)
    table = crypto.lookup(k, 8)
    assert [crypto.decrypt(k, c) for c in table] == list(range(9))
    for x in range(9):
        for y in (0, 3, 8):
            a = crypto.asked(k, one, table[x], table[y], table[1])
            answer = crypto.answered(k, other, a)
            assert crypto.decrypt(k, answer) == int((x < y) != bool(a.swap))
            assert crypto.decrypt(k, crypto.finished(k, a, answer)) == int(x < y)
    assert crypto.unfixed(crypto.fixed(91, 384)) == 91


def test_published_agreement(spark):
    """Published figures."""
    got = {r["mode"]: (r["n"], r.severity, r.actions, r.all_three) for r in Q.published_agreement(spark, "").collect()}
    assert got == {"full": (30, 25, 14, 13), "hybrid": (30, 27, 15, 14)}


def test_classes_of_the_corpus(spark):
    """Values with a class, and none."""
    rows = {(r.technique, r.id): r for r in pseudonymize.pseudonymized(tables.alerts(spark), "hybrid").collect()}
    raw = {(r.technique, r.id): r for r in tables.alerts(spark).collect()}
    for r in rows.values():
        a = raw[r.technique, r.id]
        assert r.process == f"semantic_process:{a.process}" or (a.process not in P.KNOWN_PROCESSES and r.process.startswith("semantic_process:other:tok_process_"))
        assert r.src_ip.startswith("ip_class:RFC1918:tok_ip_" if a.src_ip.startswith("10.") else "ip_class:PUBLIC:tok_ip_")
        assert r.file_path.startswith("semantic_path:" + a.file_path.rsplit("\\", 1)[1] + ":tok_file_path_")
        assert r.user.startswith("account_class:SERVICE:" if a.user == P.SERVICE_ACCOUNT else "account_class:PERSON:")


def test_secure_comparison(spark):
    k = crypto.keygen(512, 128)
    for m in (0, 1, 42, 65537):
        assert crypto.decrypt(k, crypto.encrypt(k, m)) == m
    shares = crypto.split(k.alpha)
    assert crypto.multiplied(k, crypto.encrypt(k, 17), crypto.split(23 * k.alpha)) * pow(k.alpha, -1, k.n) % k.n == 391
    assert crypto.ddlog(143, 5 * 143 + 1) == 5
    pairs = [(17, 50), (50, 50), (83, 50), (0, 1), (100, 0)] * 3
    assert [crypto.decrypt(k, crypto.compared(k, shares, x, y)) for x, y in pairs] == [int(x < y) for x, y in pairs]
    df = spark.createDataFrame(pairs[:5], "value bigint, threshold bigint")
    assert all(r.hit == (r.value < r.threshold) for r in crypto.compare_rows(df, k).collect())
    v = secrets.randbits(300)
    assert int.from_bytes(crypto.fixed(v, 384), "big") == v and len(crypto.fixed(v, 384)) == 384


def test_rank_recovery_of_ties(spark):
    rows = [(0, i, e) for i, e in enumerate([1, 0, 0, 1, 0, 0, 1, 2, 2, 0])]
    got = {r.event: (r.top1, r.top3) for r in leakage.recovery(spark.createDataFrame(rows, "trial int, event int, entity int")).collect()}
    assert got[0] == (False, False) and got[1][0] is False and got[2][0] is True and got[3][0] is False and got[9] == (True, True)
    by_event = spark.createDataFrame([(i, s) for i, s in enumerate([5, 1, 5, 5])], "event int, successes int")
    assert leakage.stable(by_event, 5, 4).first().stable_from == 3 and leakage.stable(by_event, 6, 4).first().stable_from == 4


def test_comparison_notes(spark):
    s = "alert_id int, technique string, severity string, actions array<string>, relationships array<string>"
    a = spark.createDataFrame([(i, "x" if i else "y", "high", ["a", "b"], ["r"]) for i in range(4)], s)
    b = spark.createDataFrame([(0, "y", "high", ["b", "a"], ["r"]), (1, "z", "high", ["a", "b"], ["r"]), (2, "x", "high", ["a"], ["r"]), (3, "x", "high", ["b", "a", "a"], ["r"])], s)
    truth = spark.createDataFrame([(i, "x") for i in range(4)], "alert_id int, technique string")
    rows = compare.compared(a, b, truth)
    assert [r.note for r in rows.orderBy("alert_id").collect()] == ["A misses ground truth", "B diverges from ground truth", "reasoning detail changed", "—"]
    (t,) = compare.agreement(rows).collect()
    assert (t.n, t.technique, t.actions, t.all_three, t.hallucination, t.jaccard_half) == (4, 3, 3, 2, 1, 4)


def test_comparison_report(spark):
    s = "alert_id int, technique string, severity string, actions array<string>, relationships array<string>"
    a = spark.createDataFrame([(i, "x", "high", ["a", "b"], ["r"]) for i in range(4)], s)
    b = spark.createDataFrame([(i, "x" if i else "y", "high", ["a"], ["r"]) for i in range(4)], s)
    rows = compare.compared(a, b, spark.createDataFrame([(i, "x") for i in range(4)], "alert_id int, technique string")).withColumn("mode", F.lit("full"))
    text = tables.as_markdown(compare.report(rows, "mode").orderBy("line").select("measure", "share"))
    assert text.splitlines()[:4] == ["| measure | share |", "| --- | --- |", "| Same technique | 3/4 |", "| Same severity | 4/4 |"] and len(text.splitlines()) == 2 + len(compare.MEASURES)


def test_drawn_numbers():
    seed = bytes(range(32))
    assert crypto.exact_bits(300, seed) == crypto.exact_bits(300, seed) and crypto.exact_bits(300, seed).bit_length() == 300
    assert {crypto.exact_bits(5).bit_length() for _ in range(50)} == {5} and {crypto.below(3) for _ in range(60)} == {1, 2}
    with pytest.raises(ValueError):
        crypto.below(1)


def test_cache(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("alert_id", StringType()), StructField("mode", StringType()), StructField("error", StringType())])
    home = f"file://{tmp_path}/cache"
    assert [x.count() for x in tables.read_cache(spark, home, schema)] == [0, 0]
    tables.append_cache(spark.createDataFrame([("1", "full", None), ("2", "full", "429")], schema), home)
    (tmp_path / "cache" / "part-bad.json").write_text("{broken\n")
    good, bad = tables.read_cache(spark, home, schema)
    assert good.count() == 2 and bad.cache().count() == 1
    wanted = spark.createDataFrame([("1", "full"), ("2", "full"), ("3", "full")], "alert_id string, mode string")
    assert sorted(r.alert_id for r in scoring.missing(wanted, good, ["alert_id", "mode"]).collect()) == ["2", "3"]


def test_report(spark):
    assert tables.as_markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 | — |"
    assert values(tables.as_lines(spark.createDataFrame([(1, 2.5)], "k int, ms double"))) == [("k=1 ms=2.5",)]
    with pytest.raises(ValueError):
        tables.as_markdown(spark.range(5), most=4)
    with pytest.raises(ValueError):
        scoring.positive(size=0)


def test_stable_by_plain_search(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        rows = [(i, rng.randint(0, 3), rng.randint(1, 3)) for i in range(12)]
        found = {r.kind: r.stable_from for r in leakage.stable(spark.createDataFrame(rows, "event int, a int, b int"), 2, 12, ("a", "b")).collect()}
        for k, name in ((1, "a"), (2, "b")):
            want = next((i + 1 for i in range(12) if all(r[k] >= 2 for r in rows[i:])), 12)
            assert found[name] == want


def test_counted_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", f"2024-01-01 0{i % 4}:10:00") for i in range(40)], "id int, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.counted(stream, [F.col("kind")]).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.kind, r.window.start.hour): r.n for r in spark.table("counted").collect()}
    want = {(r.kind, r.h): r["count"] for r in rows.groupBy("kind", F.hour("ts").alias("h")).count().collect()}
    assert sorted(got.values()) == sorted(want.values()) and len(got) == len(want)


def test_throughput(spark):
    rows = spark.createDataFrame([(10, 2.0), (30, 3.0)], "rows bigint, seconds double")
    assert rows.agg(scoring.throughput(F.col("rows"), F.col("seconds"))).first()[0] == 8.0


def test_maximum_from_zero(spark):
    rows = spark.createDataFrame([(-3.0,), (-1.0,)], "v double")
    assert rows.agg(scoring.largest(F.col("v"))).first()[0] == 0.0 and rows.where("false").agg(scoring.largest(F.col("v"))).first()[0] == 0.0


def test_restored_with_a_map_of_any_size(spark, monkeypatch):
    e = spark.createDataFrame([(i, f"u{i % 4}") for i in range(60)], "event_id bigint, user string")
    out = pseudonymize.pseudonymized(e, "full").withColumn("said", F.concat(F.lit("by "), F.col("user")))
    for size in (100, 1):
        monkeypatch.setattr(pseudonymize, "SMALL_MAP", size)
        back = pseudonymize.restored(out, "said", pseudonymize.reverse_map(e), ["event_id"])
        assert {(r.event_id, r.said) for r in back.collect()} == {(i, f"by u{i % 4}") for i in range(60)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1", "2024-01-01 00:00:00"), (2, "u1", "2024-01-01 01:00:00"), (3, "u2", "2024-01-01 02:00:00")], "id int, user string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = streaming.first_seen(streaming.tokenized(stream, {"user": "user"}), "user")
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.user for r in spark.table("seen").collect()} == {r.user for r in streaming.tokenized(rows, {"user": "user"}).collect()} and spark.table("seen").count() == 2


def test_entry_without_the_training_data_operators():
    """The queries of this part stand alone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys\nfor m in ('hushframe.llm', 'corpus_pipeline'):\n    sys.modules[m] = None\nimport __spark_entry__ as e\nassert 'token_user_counts' in e.queries() and not any(k.startswith('op') for k in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
