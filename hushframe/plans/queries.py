"""Queries over the driver's tables and over fixtures, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import tokens as T
from ..operators import compare, crypto, leakage, pseudonymize, scoring, validate
from ..sources import baseline, prng
from ..sources.tables import PARENTS, PROCESSES, TECHNIQUES, alerts, drawn, as_json, as_lines, read, threshold_pairs

QUERIES, ORACLES = {}, {}
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]*[A-Za-z0-9]"
#: user names for the events: every tenth user is the service account.
USER_SQL = r"(case when user_id % 10 = 0 then 'NT AUTHORITY\SYSTEM' else 'CORP\user' || user_id end)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def user_name():
    return F.when(F.col("user_id") % 10 == 0, P.SERVICE_ACCOUNT).otherwise(F.concat(F.lit("CORP\\user"), F.col("user_id").cast("string")))


# Tokens


@query(f"select {T.token_sql('user', 'user_id::varchar')} as token, count(*) as n from events group by 1")
def token_user_counts(spark, sf_dir):
    """Counted by the raw value first, so that a token is made once for each user."""
    per = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select(T.token("user", F.col("user_id")).alias("token"), "n")


@query(f"select count(distinct user_id) as n_raw, count(distinct {T.token_sql('user', 'user_id::varchar')}) as n_tokens from events")
def token_distinct(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return users.agg(F.count("user_id").alias("n_raw"), F.countDistinct(T.token("user", F.col("user_id"))).alias("n_tokens"))


@query(f"select event_type, count(*) as n, count(distinct t) as n_tokens, count(distinct user_id) as n_users, bool_and(t = again) as all_equal from (select *, {T.token_sql('user', 'user_id::varchar')} as t, {T.token_sql('user', 'cast(user_id as varchar)')} as again from events) group by 1")
def token_repeats(spark, sf_dir):
    """The same value evaluated twice, once for each event and once for each user apart, has the same token."""
    e = read(spark, sf_dir, "events").select("event_type", "user_id")
    apart = e.select("user_id").distinct().select("user_id", T.token("user", F.col("user_id")).alias("again"))
    both = e.withColumn("t", T.token("user", F.col("user_id"))).join(apart, "user_id")
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_tokens"), F.countDistinct("user_id").alias("n_users"), F.bool_and(F.col("t") == F.col("again")).alias("all_equal"))


@query("select count(*) as n_common from (select distinct user_id from events where event_id % 2 = 0) a join (select distinct user_id from events where event_id % 2 = 1) b using (user_id)")
def token_cross_party(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    a, b = (e.where(F.col("event_id") % 2 == k).select("user_id").distinct().select(T.token("user", F.col("user_id")).alias("token")) for k in (0, 1))
    return a.join(b, "token").agg(F.count(F.lit(1)).alias("n_common"))


def _digits(kind: str) -> str:
    return f"select distinct substr({T.token_sql(kind, 'user_id::varchar')}, {len(kind) + 6}) as d from events"


@query(f"select (select count(*) from ({_digits('user')}) join ({_digits('machine')}) using (d)) as n_common, count(distinct user_id) as n_users from events")
def token_type_separation(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    kinds = users.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_replace(T.token(k, F.col("user_id")), "^tok_[a-z]+_", "").alias("digits")) for k in ("user", "machine")])).alias("t")).select("t.*")
    per = kinds.groupBy("digits").agg(F.countDistinct("kind").alias("k"))
    return per.agg(F.count_if(F.col("k") > 1).alias("n_common")).crossJoin(users.agg(F.count("user_id").alias("n_users")))


_TYPE = T.token_sql("process", "event_type")


@query(f"select event_id, {T.token_sql('user', USER_SQL)} as user_out, {_TYPE} as process_out from events")
def pseudonymize_full(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", user_name().alias("user"), F.col("event_type").alias("process"))
    return pseudonymize.pseudonymized(e, "full").select("event_id", F.col("user").alias("user_out"), F.col("process").alias("process_out"))


@query(rf"select event_id, 'account_class:' || case when {USER_SQL} = 'NT AUTHORITY\SYSTEM' then 'SERVICE' else 'PERSON' end || ':' || {T.token_sql('user', USER_SQL)} as user_out, 'semantic_process:other:' || {_TYPE} as process_out from events")
def pseudonymize_hybrid(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", user_name().alias("user"), F.col("event_type").alias("process"))
    return pseudonymize.pseudonymized(e, "hybrid").select("event_id", F.col("user").alias("user_out"), F.col("process").alias("process_out"))


@query(f"""with e as (select 'seen: ' || {USER_SQL} || '.' as want, 'seen: ' || {T.token_sql('user', USER_SQL)} || '.' as said from events), m as (select distinct {USER_SQL} as raw, {T.token_sql('user', USER_SQL)} as token from events)
select count(*) as n, count(*) filter (replace(said, token, raw) = want) as n_equal from e left join m on token = regexp_extract(said, 'tok_user_[0-9a-f]+')""")
def reverse_roundtrip(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", user_name().alias("user"))
    out = pseudonymize.pseudonymized(e, "full").withColumn("said", F.concat(F.lit("seen: "), F.col("user"), F.lit(".")))
    back = pseudonymize.restored(out, "said", pseudonymize.reverse_map(e), ["event_id"])
    both = back.select("event_id", "said").join(e, "event_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == F.concat(F.lit("seen: "), F.col("user"), F.lit("."))).alias("n_equal"))


_BOTH = f"{MAIL}|{IP}"


@query(f"""with d as (select doc_id, regexp_extract_all(text, '{_BOTH}') as met, string_split_regex(text, '{_BOTH}') as parts from documents where regexp_matches(text, '{_BOTH}'))
select doc_id, len(list_distinct(met))::bigint as n_literals, sha256(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i::int] || coalesce(case when contains(met[i::int], '@') then {T.token_sql('user', 'met[i::int]')} else {T.token_sql('ip', 'met[i::int]')} end, '')), '')) as replaced_sha256 from d""")
def entity_replace_docs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(_BOTH)).select("doc_id", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_BOTH})"), F.lit(1))).alias("met"))
    pairs = F.transform("met", lambda m: X.pair(m, F.when(F.contains(m, F.lit("@")), T.token("user", m)).otherwise(T.token("ip", m))))
    return d.select("doc_id", F.size("met").cast("bigint").alias("n_literals"), F.sha2(X.replace_entities(F.col("text"), pairs).cast("binary"), 256).alias("replaced_sha256"))


@query(rf"""with r as (select m as mode, {USER_SQL} as raw, case m when 'full' then '' else 'account_class:' || case when {USER_SQL} = 'NT AUTHORITY\SYSTEM' then 'SERVICE' else 'PERSON' end || ':' end || {T.token_sql('user', USER_SQL)} as out from events, (values ('full'), ('hybrid')) t(m))
select mode, count(*) as n, count(*) filter (contains(out || chr(10) || replace('login by ' || raw || ' ok', raw, out), raw)) as n_leaked from r group by 1""")
def leak_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", user_name().alias("user"), F.concat(F.lit("login by "), user_name(), F.lit(" ok")).alias("command_line"))
    raw = e.select("event_id", F.col("user").alias("raw"))
    found = None
    for mode in pseudonymize.MODES:
        out = pseudonymize.pseudonymized(e, mode).join(raw, "event_id").select(F.lit(mode).alias("mode"), P.leaked(F.concat_ws("\n", "user", "command_line"), [F.col("raw")]).alias("leak"))
        found = out if found is None else found.unionByName(out)
    return found.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("leak").alias("n_leaked"))


# Predicates


@query(rf"""with a as (select unnest(regexp_extract_all(text, '{IP}')) as ip from documents)
select case when ip like '10.%' or ip like '192.168.%' or (ip like '172.%' and try_cast(split_part(ip, '.', 2) as int) between 16 and 31) then 'RFC1918' else 'PUBLIC' end as ip_class, count(*) as n from a group by 1""")
def ip_class_docs(spark, sf_dir):
    ips = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({IP})"), F.lit(1))).alias("ip"))
    return ips.groupBy(P.ip_class(F.col("ip")).alias("ip_class")).agg(F.count(F.lit(1)).alias("n"))


@query(r"select page_id, regexp_extract(url, '([^\\/]*)$', 1) as base from pages")
def basename_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", P.basename(F.col("url")).alias("base"))


@query("select event_type, lower(event_type) in ('login', 'click', 'error') as is_known, count(*) as n from events group by 1, 2")
def known_types(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", P.known(F.col("event_type"), ("login", "click", "error")).alias("is_known")).agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, case when not (o_orderstatus in ('O', 'F', 'P')) then 1 when not (o_totalprice between 1000 and 400000) then 2
  when not (strlen(o_orderpriority) between 1 and 8) then 3 when not (o_orderdate < timestamp '1998-01-01') then 4 else 0 end as code from orders""")
def validate_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    code = P.first_failure((F.col("o_orderstatus").isin("O", "F", "P"), 1), (F.col("o_totalprice").between(1000, 400000), 2), (P.text_ok(F.col("o_orderpriority"), 8), 3), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), 4))
    return o.select("o_orderkey", code.alias("code"))


@query("""select doc_id, case when not (strlen(text) between 1 and 4000) then 1 when strlen(text) <> length(text) then 2 else 0 end as code, strlen(text)::bigint as n_bytes from documents""")
def validate_text(spark, sf_dir):
    t = F.col("text")
    code = P.first_failure((F.octet_length(t).between(1, 4000), 1), (P.text_ok(t, 4000), 2))
    return read(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.octet_length(t).cast("bigint").alias("n_bytes"))


_EPOCH = "(epoch(date_trunc('day', ts)) // 86400)::bigint"
_NULLIFIER = f"sha256(encode('{T.NULLIFIER_DOMAIN}') || unhex(sha256(encode(user_id::varchar))) || unhex(md5(event_type)) || unhex(lpad(hex({_EPOCH}), 16, '0')))"


@query(f"with n as (select event_type, {_NULLIFIER} as nullifier from events) select event_type, count(*) as n, count(distinct nullifier) as n_distinct, count(*) - count(distinct nullifier) as n_replayed, min(nullifier) as least from n group by 1")
def nullifier_daily(spark, sf_dir):
    """Counted by what a nullifier is made of, so that it is made once for each user, type and day."""
    day = F.expr("unix_date(to_date(ts))").alias("day")
    made = T.nullifier(F.unhex(F.sha2(F.encode(F.col("user_id").cast("string"), "utf-8"), 256)), F.unhex(F.md5(F.encode("event_type", "utf-8"))), F.col("day"))
    per = read(spark, sf_dir, "events").groupBy("event_type", "user_id", day).agg(F.count(F.lit(1)).alias("c")).withColumn("nullifier", made)
    return per.groupBy("event_type").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("c") - F.count(F.lit(1))).alias("n_replayed"), F.min("nullifier").alias("least"))


@query(f"select sha256(encode('{T.RECIPIENT_DOMAIN}') || unhex('00000100') || unhex(repeat('c3', 256)) || unhex('010001')) as key_hash")
def recipient_key_hash(spark, sf_dir):
    return spark.range(1).select(T.recipient_key_hash(T.binary(b"\xc3" * 256), T.binary(b"\x01\x00\x01")).alias("key_hash"))


@query(f"select sha256('{validate.DESCRIPTOR}') as commitment")
def schema_commitment(spark, sf_dir):
    return spark.range(1).select(T.commitment(F.lit(validate.DESCRIPTOR)).alias("commitment"))


#: name, what it changes in the valid alert, and in the commitment and the modulus: fixtures, some of which break several checks at once.
WITNESSES = [
    ("valid", {}, {}),
    ("severity", {"severity": 0}, {}),
    ("zero_id", {"alert_id": bytes(16)}, {}),
    ("not_ascii", {"user": "USER_älice"}, {}),
    ("schema", {}, {"schema_commitment": "0" * 64}),
    ("modulus", {}, {"recipient_modulus": b"\x43" * 256}),
    ("long", {"file_path": "x" * 128}, {}),
    ("early_and_schema", {"timestamp": 1}, {"schema_commitment": "0" * 64}),
    ("schema_and_modulus", {}, {"schema_commitment": "0" * 64, "recipient_modulus": b"\xc3" * 255}),
    ("modulus_and_long", {"file_path": "x" * 128}, {"recipient_modulus": b"\x43" * 256}),
    ("all", {"category": 5, "file_path": "x" * 128}, {"schema_commitment": "0" * 64, "recipient_modulus": b"\x43" * 256}),
]
_ALERT = dict(schema_version=1, alert_id=b"synthetic-alert!", timestamp=1783512000, severity=8, category=2, user="USER_alice", machine="HOST-finance-07", process="powershell.exe", ip="203.0.113.42", file_path="C:\\Synthetic\\payload.ps1")
_KEYS = dict(schema_commitment=hashlib.sha256(validate.DESCRIPTOR.encode()).hexdigest(), recipient_modulus=b"\xc3" * 256)


def witnesses(spark):
    """A valid typed alert and others that break native checks, one or several."""
    schema = "name string, alert struct<schema_version int, alert_id binary, timestamp bigint, severity smallint, category smallint, user string, machine string, process string, ip string, file_path string>, schema_commitment string, recipient_modulus binary"
    rows = [(name, {k: bytearray(v) if isinstance(v, bytes) else v for k, v in (_ALERT | alert).items()}, *[bytearray(v) if isinstance(v, bytes) else v for v in (_KEYS | keys).values()]) for name, alert, keys in WITNESSES]
    return spark.createDataFrame(rows, schema)


def _witness_sql() -> str:
    def value(v):
        return f"unhex('{v.hex()}')" if isinstance(v, bytes) else str(v) if isinstance(v, int) else "'{}'".format(v.replace("'", "''"))

    rows = ", ".join("('" + name + "', " + ", ".join(value(v) for v in [*(_ALERT | alert).values(), *(_KEYS | keys).values()]) + ")" for name, alert, keys in WITNESSES)
    bad_text = " or ".join(f"strlen({c}) not between 1 and {n} or strlen({c}) <> length({c})" for c, n in validate.TEXTS.items())
    size = "28 + " + " + ".join(f"8 + strlen({c})" for c in validate.TEXTS)
    return f"""with w(name, {', '.join([*_ALERT, *_KEYS])}) as (values {rows}), s as (select *, {size} as n from w)
select name, case when schema_version <> 1 or octet_length(alert_id) <> 16 or alert_id = unhex('{"00" * 16}') or "timestamp" not between {validate.EARLIEST} and {validate.LATEST} or severity not between 1 and {validate.MAX_SEVERITY} or category not between 0 and {validate.MAX_CATEGORY} or {bad_text} then 1
  when schema_commitment <> '{_KEYS["schema_commitment"]}' then 2 when octet_length(recipient_modulus) <> 256 or hex(recipient_modulus) < '8' then 7 when n > {validate.MAX_PLAIN} then 9 else 0 end as code, n::int as n_bytes from s"""


@query(_witness_sql())
def validate_witnesses(spark, sf_dir):
    return validate.checked(witnesses(spark)).select("name", "code", F.octet_length(validate.alert_bytes(lambda c: F.col("alert")[c])).alias("n_bytes"))


#: Which checks of the signed witnesses are broken, by their codes; the first in order is what validation must say.
BROKEN = {"valid": (), "key": (4,), "key_and_modulus": (4, 7), "form": (5,), "form_and_key_size": (5, 8), "signature": (6,), "signature_and_long": (6, 9), "modulus": (7,), "modulus_and_cipher": (7, 10), "exponent": (8,), "exponent_and_long": (8, 9), "long": (9,), "cipher": (10,), "bounds_and_key": (1, 4), "schema_and_signature": (2, 6)}


def signed_witnesses(spark):
    """A witness for each entry of BROKEN, signed and encrypted with fixed keys, with just those checks broken."""
    x, y = crypto.times(12345, crypto.G)
    key, n, seed = bytes([2 + y % 2]) + x.to_bytes(32, "big"), (1 << 2047) + 9, bytes(range(32))
    plain = {}
    names = spark.createDataFrame([(name, _ALERT | {"alert_id": bytearray(_ALERT["alert_id"])} | ({"severity": 0} if 1 in b else {}) | ({"file_path": "x" * 128} if 9 in b else {})) for name, b in BROKEN.items()], "name string, alert struct<schema_version int, alert_id binary, timestamp bigint, severity smallint, category smallint, user string, machine string, process string, ip string, file_path string>")
    plain = {r.name: bytes(r.plain) for r in names.select("name", validate.alert_bytes(lambda c: F.col("alert")[c]).alias("plain")).collect()}  # a row for each entry of BROKEN
    rows = []
    for name, b in BROKEN.items():
        sig = crypto.signed(plain[name], 12345, 777)
        cipher = bytes(256) if 10 in b or 9 in b else crypto.encrypted(plain[name], n, 65537, seed)
        rows.append((name, _KEYS["schema_commitment"] if 2 not in b else "0" * 64, b"\x05" + key[1:] if 4 in b else key, bytes(64) if 5 in b else sig[:-1] + bytes([sig[-1] ^ 1]) if 6 in b else sig, n.to_bytes(256, "big") if 7 not in b else bytes(256), b"\x01\x00\x01" if 8 not in b else b"\x02", seed, cipher))
    rows = [tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows]
    keys = spark.createDataFrame(rows, "name string, schema_commitment string, sensor_public_key binary, sensor_signature binary, recipient_modulus binary, recipient_exponent binary, encryption_seed binary, expected_ciphertext binary")
    return names.join(F.broadcast(keys), "name")


@query("with b(name, codes) as (values " + ", ".join(f"('{name}', {list(b)}::int[])" for name, b in BROKEN.items()) + f") select name, coalesce(list_min(codes), 0)::int as code, case when len(codes) = 0 then 425 end::int as n_public from b")
def validate_signed(spark, sf_dir):
    """All ten checks in order, and how many bytes a valid witness makes public."""
    rows = validate.checked(signed_witnesses(spark)).withColumn("plain", validate.alert_bytes(lambda c: F.col("alert")[c]))
    hashed = T.recipient_key_hash(F.col("recipient_modulus"), F.col("recipient_exponent"))
    public = validate.public_bytes(F.col("expected_ciphertext"), F.col("schema_commitment"), F.col("sensor_public_key"), hashed, T.binary(bytes(16)), F.lit(7), T.nullifier(T.binary(bytes(32)), T.binary(bytes(16)), F.lit(7)))
    return crypto.completed(rows, "plain").select("name", "code", F.when(F.col("code") == 0, F.octet_length(public)).alias("n_public"))


# Scoring and statistics

KS = (5, 10, 20, 50, 100, 200, 500)


@query(f"""with p as (select k, ((31 * a + 7 * ((17 * a + 13 * n) % 50)) % 101) as v, ((19 * n + 23) % 101) as t from range(1000) x(a), unnest({list(KS)}) y(k), range(500) z(n) where n < k)
select k::int as k, count(*) as n_rows, count(*) filter (v < t) as hits, count(*) filter (v = t) as ties from p group by 1""")
def threshold_pairs_hits(spark, sf_dir):
    """Summed for each node first, then for each k over the nodes below it."""
    nodes = scoring.hits(threshold_pairs(spark, 1000, max(KS)), ["node"])
    each = nodes.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in KS]), lambda k: F.col("node") < k)))
    return each.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n_rows", "hits", "ties")])


@query("""with e as (select vec_id, unnest(embedding[1:50]) as v, unnest(range(50)) as n from embeddings)
select vec_id, count(*) filter (v < ((19 * n + 23) % 101 - 50) / 200.0) as hits, count(*) as comparisons from e group by 1""")
def threshold_scorer(spark, sf_dir):
    nodes = spark.range(50).select(F.col("id").alias("node"), (((19 * F.col("id") + 23) % 101 - 50) / 200).alias("threshold"))
    return scoring.scored(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", nodes, 50)


@query("""with b as (select event_id // 300 as batch, sum(value) as ms, count(*) as n from events group by 1)
select round(sum(ms) / sum(n), 6) as mean_of_rows, round(avg(ms / n), 6) as mean_of_batches, round(stddev_pop(ms / n), 6) as sd, round(min(ms / n), 6) as least, round(max(ms / n), 6) as most, count(*) as n_batches from b""")
def batch_stats(spark, sf_dir):
    per = scoring.batches(read(spark, sf_dir, "events"), "event_id", 300).groupBy("batch").agg(F.sum("value").alias("ms"), F.count(F.lit(1)).alias("n"))
    return scoring.batch_summary(per, "ms", "n")


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as least, max(value) as most from events group by 1")
def stats_by_type(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*scoring.summary(F.col("value")))


@query("select event_type, greatest(coalesce(max(200 - value), 0), 0) as most_left, greatest(coalesce(max(-value), 0), 0) as most_below from events group by 1")
def largest_from_zero(spark, sf_dir):
    """Maxima that start at 0, as they are taken of times; of negative values nothing is left."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(scoring.largest(200 - F.col("value")).alias("most_left"), scoring.largest(-F.col("value")).alias("most_below"))


@query("with b as (select event_type, event_id // 300 as batch, count(*) as n, sum(value) / 1000 as seconds from events group by 1, 2) select event_type, round(sum(n) / sum(seconds), 6) as per_second, count(*) as n_batches from b group by 1")
def throughput_by_type(spark, sf_dir):
    per = scoring.batches(read(spark, sf_dir, "events"), "event_id", 300).groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") / 1000).alias("seconds"))
    return per.groupBy("event_type").agg(F.round(scoring.throughput(F.col("n"), F.col("seconds")), 6).alias("per_second"), F.count(F.lit(1)).alias("n_batches"))


@query("""with q as (select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as pos, text as asked from conversations where role = 'user'),
r as (select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as pos, text as replied from conversations where role = 'assistant') select conv_id, pos, asked, replied from q join r using (conv_id, pos)""")
def zipped_turns(spark, sf_dir):
    """The first thing asked with the first reply of a conversation, the second with the second, and so on."""
    c = read(spark, sf_dir, "conversations")
    asked, replied = (scoring.numbered_within(c.where(F.col("role") == role).select("conv_id", "turn", "text"), ["conv_id"], [F.col("turn"), F.col("text")]).select("conv_id", "pos", F.col("text").alias(name)) for role, name in (("user", "asked"), ("assistant", "replied")))
    return scoring.zipped(asked, replied, ["conv_id"])


@query("select user_id, greatest(max(value) filter (event_id % 2 = 0), max(value) filter (event_id % 2 = 1)) as slower, (sum(event_id) // count(*))::bigint as mean_id from events group by 1")
def party_times(spark, sf_dir):
    by = [F.max(F.when(F.col("event_id") % 2 == k, F.col("value"))) for k in (0, 1)]
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(*by).alias("slower"), F.expr("sum(event_id) div count(1)").alias("mean_id"))


@query("select conv_id, role, turn, text from (select *, row_number() over (partition by conv_id, role order by turn desc, text desc) as r from conversations) where r = 1")
def latest_record(spark, sf_dir):
    return scoring.latest(read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], [F.col("turn"), F.col("text")])


@query("""select conv_id, m as mode from (select distinct conv_id from conversations), (values ('original'), ('full'), ('hybrid')) t(m)
where (conv_id, m) not in (select (conv_id, case turn % 3 when 0 then 'original' when 1 then 'full' else 'hybrid' end) from conversations where text not like '%e%e%e%e%e%e%e%e%')""")
def cache_misses(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    modes = spark.createDataFrame([("original",), ("full",), ("hybrid",)], "mode string")
    cache = c.select("conv_id", F.element_at(F.array(F.lit("original"), F.lit("full"), F.lit("hybrid")), (F.col("turn") % 3 + 1).cast("int")).alias("mode"), F.when(F.col("text").like("%e%e%e%e%e%e%e%e%"), "slow").alias("error"))
    return scoring.missing(c.select("conv_id").distinct().crossJoin(F.broadcast(modes)), cache, ["conv_id", "mode"])


@query("select m as mode, count(*) as n, min(doc_id) as least from documents, (values ('original'), ('full'), ('hybrid')) t(m) group by 1")
def mode_expansion(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(m) for m in ("original", "full", "hybrid")])).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))


# Comparison


def answers_of_halves(spark, sf_dir):
    """For each user an answer from either half of the month, made of what the user did there."""
    e = read(spark, sf_dir, "events").withColumn("half", F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b"))
    per = e.groupBy(F.col("user_id").alias("alert_id"), "half").agg(F.min("event_type").alias("technique"), F.when(F.avg("value") > 245, "high").otherwise("low").alias("severity"), F.collect_set(F.when(F.col("value") > 350, F.col("event_type"))).alias("actions"), F.collect_set(F.when(F.col("value") > 400, F.col("event_type"))).alias("relationships"))
    return [per.where(F.col("half") == h).drop("half") for h in "ab"]


_HALVES = """h as (select user_id as alert_id, case when day(ts) <= 15 then 'a' else 'b' end as half, min(event_type) as technique, case when avg(value) > 245 then 'high' else 'low' end as severity,
  coalesce(list_sort(list(distinct event_type) filter (value > 350)), []) as actions, coalesce(list(distinct event_type) filter (value > 400), []) as rel from events group by 1, 2),
c as (select a.alert_id, a.technique = t.truth as right_a, b.technique = t.truth as right_b, a.technique = b.technique as same_technique, a.severity = b.severity as same_severity, a.actions = b.actions as same_actions,
  case when len(list_distinct(a.actions || b.actions)) = 0 then 1.0::double else round(len(list_intersect(a.actions, b.actions))::double / len(list_distinct(a.actions || b.actions)), 6) end as jaccard, len(b.rel) < len(a.rel) as fewer
  from h a join h b using (alert_id) join (select user_id as alert_id, min(event_type) as truth from events where event_id % 2 = 0 group by 1) t using (alert_id) where a.half = 'a' and b.half = 'b')"""


def compared_halves(spark, sf_dir):
    truth = read(spark, sf_dir, "events").where(F.col("event_id") % 2 == 0).groupBy(F.col("user_id").alias("alert_id")).agg(F.min("event_type").alias("technique"))
    return compare.compared(*answers_of_halves(spark, sf_dir), truth)


@query(f"""with {_HALVES} select *, right_a and not right_b as hallucination, case when not right_a then 'A misses ground truth' when right_a and not right_b then 'B diverges from ground truth'
  when not same_severity or not same_actions or fewer then 'reasoning detail changed' else '—' end as note from c""")
def agreement_rows(spark, sf_dir):
    return compared_halves(spark, sf_dir)


@query(f"""with {_HALVES} select count(*) as n, count(*) filter (same_technique) as technique, count(*) filter (same_severity) as severity, count(*) filter (same_actions) as actions,
  count(*) filter (same_technique and same_severity and same_actions) as all_three, count(*) filter (fewer) as fewer, count(*) filter (right_a and not right_b) as hallucination,
  count(*) filter (jaccard >= 0.5) as jaccard_half, round(avg(jaccard), 6) as mean_jaccard, bool_and(same_technique) as all_same from c""")
def agreement(spark, sf_dir):
    return compare.agreement(compared_halves(spark, sf_dir))


@query("select lang, count(*) as n, count(*) filter ((n_chars > 600)::int = quality) as \"right\" from documents join labels using (doc_id) group by 1")
def accuracy_by_lang(spark, sf_dir):
    answers = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 600).cast("int").alias("answer"))
    return compare.accuracy(answers, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id", "lang")


@query("select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as n_k, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k from events group by 1")
def json_extract(spark, sf_dir):
    k = X.at_path(F.col("props"), "$.k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("n_k"), F.sum(k.try_cast("bigint")).alias("sum_k"))


_GOOD = '{"technique": "phishing", "severity": "high", "actions": ["isolate", "reset"], "relationships": []}'
TEXTS = [("plain", _GOOD), ("fenced", f"```json\n{_GOOD}\n```"), ("prose", f"Here it is: {_GOOD} I hope so."), ("none", "I cannot tell."), ("inverted", "}{"), ("partial", '{"technique": "phishing"}')]


_TEXTS_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEXTS)


@query(f"""with t(name, text) as (values {_TEXTS_SQL}), j as (select name, try_cast(nullif(regexp_extract(text, '\\{{.*\\}}', 0, 's'), '') as json) as j from t),
f as (select name, case when (j -> 'technique') is not null and (j -> 'severity') is not null and (j -> 'actions') is not null and (j -> 'relationships') is not null then j end as j from j)
select name, j ->> 'technique' as technique, json_array_length(j -> 'actions')::int as n_actions from f""")
def answer_extract(spark, sf_dir):
    a = X.answer(F.col("text"))
    return spark.createDataFrame(TEXTS, "name string, text string").select("name", a["technique"].alias("technique"), F.size(a["actions"]).alias("n_actions")).withColumn("n_actions", F.when(F.col("technique").isNotNull(), F.col("n_actions")))


# Leakage


@query("select case when v < 40 then 0 when v < 65 then 1 when v < 80 then 2 when v < 90 then 3 when v < 96 then 4 else 5 end as entity, count(*) as n from (select floor(value)::bigint % 100 as v from events) group by 1")
def bucket_lookup(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(leakage.bucket(F.floor("value") % 100).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


_ENTITIES = "e as (select (event_id // 500)::bigint as trial, (event_id % 500)::bigint as event, case when v < 40 then 0 when v < 65 then 1 when v < 80 then 2 when v < 90 then 3 when v < 96 then 4 else 5 end as entity from (select event_id, floor(value)::bigint % 100 as v from events))"
_RUNS = ", ".join(f"sum((entity = {i})::int) over (partition by trial order by event) as c{i}" for i in range(6))


def entity_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.expr("event_id div 500").alias("trial"), (F.col("event_id") % 500).alias("event"), leakage.bucket(F.floor("value") % 100).alias("entity"))


_TOPS = f"{_ENTITIES}, r as (select trial, event, {_RUNS} from e), t as (select trial, event, c0 > greatest(c1, c2, c3, c4, c5) as top1, c0 > c1 and c1 > c2 and c2 > greatest(c3, c4, c5) as top3 from r)"


@query(f"with {_TOPS} select trial, count(*) filter (top1) as n_top1, count(*) filter (top3) as n_top3 from t group by 1")
def running_rank(spark, sf_dir):
    return leakage.recovery(entity_events(spark, sf_dir)).groupBy("trial").agg(F.count_if("top1").alias("n_top1"), F.count_if("top3").alias("n_top3"))


def _stable_sql(kind: str) -> str:
    return f"select '{kind}' as kind, coalesce(min(event + 1) filter (holds), 500)::bigint as stable_from from (select event, bool_and(s_{kind} >= (select ceil(0.6 * count(distinct trial)) from t)) over (order by event rows between current row and unbounded following) as holds from s)"


@query(f"with {_TOPS}, s as (select event, count(*) filter (top1) as s_top1, count(*) filter (top3) as s_top3 from t group by 1) {_stable_sql('top1')} union all {_stable_sql('top3')}")
def stable_rank(spark, sf_dir):
    e = entity_events(spark, sf_dir)
    trials = e.agg(F.countDistinct("trial")).first()[0]
    return leakage.rank_recovery(e, trials, 500, 0.6)


@query("select * from (values ('top1', 71::bigint), ('top3', 293::bigint)) t(kind, stable_from)")
def rank_recovery_exact(spark, sf_dir):
    """500 trials of 5,000 draws from the pseudo-random stream; the observations needed are published figures."""
    import pandas as pd

    draws = prng.bounded(0xFEE1DEAD, 100, 500 * 5000)
    pdf = pd.DataFrame({"trial": [i // 5000 for i in range(0, len(draws), 5000)], "draws": [bytes(draws[i : i + 5000].astype("uint8")) for i in range(0, len(draws), 5000)]})
    events = spark.createDataFrame(pdf, "trial bigint, draws binary").select("trial", F.posexplode(F.split(F.hex("draws"), "(?<=\\G..)")).alias("event", "digits")).where("digits <> ''")
    events = events.select("trial", "event", leakage.bucket(F.conv("digits", 16, 10).cast("int")).alias("entity"))
    return leakage.rank_recovery(events, 500, 5000)


# The generated corpus


def _listed(values, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{at} + 1]"


_DRAWN = ", ".join(f"({t}, {v}, '{i}', '{at}', {pid}, {size})" for t, v, i, at, pid, size in drawn())
_ALERTS = rf"""d(t, v, id, drawn_at, pid, bytes) as (values {_DRAWN}),
n as (select *, {_listed(TECHNIQUES, "t")} as technique, case when v % 2 = 0 then 'NT AUTHORITY\SYSTEM' else 'CONTOSO\analyst' || v end as "user", 'WKSTN-0' || (v + 1) as machine,
  case when v = 4 then 'svchost.exe' else {_listed(PROCESSES, "t")} end as process, {_listed(PARENTS, "t")} as parent_process, case when v % 2 = 1 then '198.51.100.42' else '10.0.0.8' end as src_ip, case when v % 2 = 1 then '203.0.113.77' else '192.168.1.20' end as dst_ip,
  case when v = 4 then 'C:\Windows\System32\svchost.exe' when t = 0 then 'C:\Windows\System32\lsass.exe' when t = 2 then 'C:\Users\analyst' || v || '\Downloads\invoice.docm' when t = 3 then 'C:\Finance\quarterly-results.zip' else 'C:\Users\analyst' || v || '\Downloads\payload' || t || '.exe' end as file_path,
  case when t = 2 then 'login-microsoft.example' else 'corp.contoso.example' end as domain, case when v < 2 then repeat('a', 64) else lpad(lower(hex(t * 10 + v)), 64, '0') end as file_hash from d),
a as (select *, process || case t when 0 then ' MiniDump target=' || file_path || ' full' when 1 then ' remote_exec destination=' || dst_ip when 2 then ' open_attachment=' || file_path || ' sender=' || domain when 3 then ' copy source=' || file_path || ' destination=' || dst_ip when 4 then ' elevation=/high' else ' delete_shadows=/all,/quiet' end as command_line,
  parent_process || ' spawned ' || process || chr(10) || process || ' connected to destination' as relationships from n)"""


def _rendered_sql(field: str, mode: str) -> str:
    """What stands instead of a field's value, in SQL."""
    kind = pseudonymize.FIELDS[field]
    name = f'"{field}"'
    t = T.token_sql(kind, name)
    base = f"regexp_extract({name}, '([^\\\\/]*)$', 1)"
    if mode == "full" or kind not in ("user", "ip", "process", "file_path"):
        return t
    if kind == "user":
        return f"'account_class:' || case when {name} = 'NT AUTHORITY' || chr(92) || 'SYSTEM' then 'SERVICE' else 'PERSON' end || ':' || {t}"
    if kind == "ip":
        return f"'ip_class:' || case when {name} like '10.%' or {name} like '192.168.%' or regexp_matches({name}, '^172[.](1[6-9]|2[0-9]|3[01])[.]') then 'RFC1918' else 'PUBLIC' end || ':' || {t}"
    if kind == "process":
        known = ", ".join(f"'{p}'" for p in P.KNOWN_PROCESSES)
        return f"case when lower({base}) in ({known}) then 'semantic_process:' || lower({base}) else 'semantic_process:other:' || {t} end"
    return f"'semantic_path:' || {base} || ':' || {t}"


#: The order in which the values of the corpus can be replaced one after the other, by signs first, so that nothing put in is looked at again: none holds a later one.
_ORDER = ("file_path", "domain", "dst_ip", "src_ip", "parent_process", "process")


def _alerts_sql(mode: str) -> str:
    """The pseudonymised corpus."""
    def replaced(text):
        for i, field in enumerate(_ORDER):
            text = f"replace({text}, {field}, chr({14 + i}))"
        for i, field in enumerate(_ORDER):
            text = f"replace({text}, chr({14 + i}), {_rendered_sql(field, mode)})"
        return text

    fields = ", ".join(f'{_rendered_sql(f, mode)} as "{f}"' for f in pseudonymize.FIELDS)
    return f"""{_ALERTS}, "{mode}" as (select id, drawn_at as "timestamp", pid::bigint as pid, bytes::bigint as bytes, technique, {fields}, {replaced("command_line")} as command_line, {replaced("relationships")} as relationships from a)"""


_ALL_FIELDS = ["technique", *pseudonymize.FIELDS]
_CARDINALITIES = " union all ".join(f"""select '{f}' as field, count(distinct "{f}")::int as n_values from a""" for f in _ALL_FIELDS)


@query(f"with {_ALERTS} {_CARDINALITIES}")
def alerts_cardinalities(spark, sf_dir):
    a = alerts(spark)
    return a.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _ALL_FIELDS])).alias("x")).groupBy("x.field").agg(F.countDistinct("x.value").cast("int").alias("n_values"))


#: In hybrid mode classes show parts of other values, so the audit is of these.
_AUDITED = {"full": list(pseudonymize.FIELDS), "hybrid": ["user", "machine", "src_ip", "dst_ip", "domain", "file_hash"]}


def _audit_sql(mode: str) -> str:
    texts = " || chr(10) || ".join(f'o."{f}"' for f in [*pseudonymize.FIELDS, "command_line", "relationships"])
    leaked = " or ".join(f'contains({texts}, a."{f}")' for f in _AUDITED[mode])
    back = "o.command_line"
    for f in ("process", "file_path", "dst_ip", "domain"):
        back = f"replace({back}, {T.token_sql(pseudonymize.FIELDS[f], 'a.' + f)}, a.{f})"
    return f"select '{mode}' as mode, count(*) as n, count(*) filter ({leaked}) as n_leaked, count(*) filter ({back} = a.command_line) as n_back from a join \"{mode}\" o using (id)"


@query(f"with {_alerts_sql('full')}, {_alerts_sql('hybrid').removeprefix(_ALERTS + ', ')} {_audit_sql('full')} union all {_audit_sql('hybrid')}")
def alerts_pseudonymized(spark, sf_dir):
    """All raw values gone from all texts of a row, and in full mode the command line restored from the reverse map. In hybrid mode users, machines, addresses, domains and hashes are audited."""
    a = alerts(spark)
    found = None
    for mode, fields in _AUDITED.items():
        out = pseudonymize.pseudonymized(a, mode)
        back = pseudonymize.restored(out.select("id", "command_line"), "command_line", pseudonymize.reverse_map(a, mode), ["id"]).select("id", F.col("command_line").alias("back"))
        raw = a.select("id", F.col("command_line").alias("line"), *[F.col(f).alias(f"raw_{f}") for f in fields])
        both = out.join(raw, "id").join(back, "id")
        texts = F.concat_ws("\n", *pseudonymize.FIELDS, "command_line", F.array_join("relationships", "\n"))
        row = both.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.count_if(P.leaked(texts, [F.col(f"raw_{f}") for f in fields])).alias("n_leaked"), F.count_if(F.col("back") == F.col("line")).alias("n_back"))
        found = row if found is None else found.unionByName(row)
    return found


@query(f"with {_alerts_sql('full')} select * from \"full\"")
def alerts_full(spark, sf_dir):
    return pseudonymize.pseudonymized(alerts(spark), "full").withColumn("relationships", F.array_join("relationships", "\n"))


@query(f"with {_alerts_sql('hybrid')} select * from hybrid")
def alerts_hybrid(spark, sf_dir):
    return pseudonymize.pseudonymized(alerts(spark), "hybrid").withColumn("relationships", F.array_join("relationships", "\n"))


@query(f"""with {_ALERTS} select count(*) as n, count(*) filter (contains(to_json({{'id': id, 'user': "user", 'command_line': command_line, 'relationships': relationships}})::varchar, '"technique"')) as n_labels, sum(strlen(id) + strlen("user") + strlen(command_line))::bigint as n_bytes from a""")
def alerts_json(spark, sf_dir):
    rows = as_json(alerts(spark), label="technique")
    value = [X.at_path(F.col("json"), f"$.{c}") for c in ("id", "user", "command_line")]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("json", F.lit('"technique"'))).alias("n_labels"), F.sum(sum((F.octet_length(v) for v in value), F.lit(0))).cast("bigint").alias("n_bytes"))


@query(f"select mode, count(*) as n, count(*) filter (severity) as severity, count(*) filter (actions) as actions, count(*) filter (severity and actions) as all_three from {baseline.answers_sql()} group by 1")
def published_agreement(spark, sf_dir):
    """The published comparison of analyses, by mode."""
    rows = spark.createDataFrame(baseline.answers(), "row int, mode string, severity boolean, actions boolean")
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("severity").alias("severity"), F.count_if("actions").alias("actions"), F.count_if(F.col("severity") & F.col("actions")).alias("all_three"))


# Published measurements


@query(f"select round(regr_intercept(ms, k), 6) as intercept, round(regr_slope(ms, k), 6) as slope, round(regr_r2(ms, k), 6) as r2 from {baseline.sql(baseline.BY_K)}")
def fit_baseline(spark, sf_dir):
    return scoring.line(baseline.table(spark, baseline.BY_K), "ms", "k")


@query(f"with w as (select * from {baseline.sql(baseline.BY_WORKERS)}) select workers, ms, round((select ms from w where workers = 1) / ms, 6) as speedup, round(100 * (select ms from w where workers = 1) / ms / workers, 6) as efficiency from w")
def scaling(spark, sf_dir):
    return scoring.scaling(baseline.table(spark, baseline.BY_WORKERS), "workers", "ms")


@query("select k::int as k, a::int as alerts, round(1920.0 * k * a / 1e9, 6)::double as gb_a_day from unnest([20, 50, 100, 200, 500]) x(k), unnest([1000, 10000, 100000]) y(a)")
def traffic(spark, sf_dir):
    grid = spark.createDataFrame([(k, a) for k in (20, 50, 100, 200, 500) for a in (1000, 10_000, 100_000)], "k int, alerts int")
    return grid.select("k", "alerts", F.round(scoring.traffic(F.col("k"), F.col("alerts")), 6).alias("gb_a_day"))


@query("select k::int as k, round(960.409 * k / 50 / 3.6e6 * 2 * 10000 * 365, 4)::double as hours, round(960.409 * k / 50 / 3.6e6 * 2 * 10000 * 365 * 0.04, 4)::double as dollars from unnest([20, 50, 200]) x(k)")
def cost(spark, sf_dir):
    ks = spark.createDataFrame([(k,) for k in (20, 50, 200)], "k int")
    hours, dollars = scoring.yearly_cost(F.lit(960.409) * F.col("k") / 50)
    return ks.select("k", F.round(hours, 4).alias("hours"), F.round(dollars, 4).alias("dollars"))


@query(f"select k, ms, round(19.483 * k, 3) as estimate, round(ms - 19.483 * k, 3) as gap, round(ms * 1000 / k, 3) as us_a_step from {baseline.sql(baseline.UNBATCHED)}")
def estimate_gap(spark, sf_dir):
    t = baseline.table(spark, baseline.UNBATCHED)
    return t.select("k", "ms", F.round(F.lit(19.483) * F.col("k"), 3).alias("estimate"), F.round(F.col("ms") - F.lit(19.483) * F.col("k"), 3).alias("gap"), F.round(scoring.per_step(F.col("ms"), F.col("k")), 3).alias("us_a_step"))


@query("select o_orderpriority, round(regr_slope(o_totalprice, n), 4) as slope, round(regr_intercept(o_totalprice, n), 4) as intercept, round(regr_r2(o_totalprice, n), 6) as r2, count(*) as n_orders from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def regression_orders(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    both = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.round(F.regr_slope("o_totalprice", "n"), 4).alias("slope"), F.round(F.regr_intercept("o_totalprice", "n"), 4).alias("intercept"), F.round(F.regr_r2("o_totalprice", "n"), 6).alias("r2"), F.count(F.lit(1)).alias("n_orders"))


@query("select event_type, 'event_type=' || event_type || ' n=' || count(*) as line from events group by 1")
def result_lines(spark, sf_dir):
    per = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return as_lines(per).select(F.regexp_extract("line", "event_type=([^ ]*)", 1).alias("event_type"), "line")
