"""Pseudonymisation of alert records, fully or with classes left visible, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import account_class, basename, ip_class, known
from ..functions.text import TOKEN, by_length, pair, replace_ordered, restore
from ..functions.tokens import TEST_KEY, Key, token

#: Field to type of token, in the order in which text is searched.
FIELDS = {"user": "user", "machine": "machine", "process": "process", "parent_process": "process", "src_ip": "ip", "dst_ip": "ip", "file_path": "file_path", "domain": "domain", "file_hash": "file_hash"}
MODES = ("full", "hybrid")


def rendered(field: str, raw: Column, mode: str = "full", key: Key = TEST_KEY) -> Column:
    """What stands in the record instead of a field's raw value."""
    t = token(FIELDS[field], raw, key)
    if mode == "full":
        return t
    if mode != "hybrid":
        raise ValueError(f"mode must be one of {MODES}")
    kind = FIELDS[field]
    if kind == "user":
        return F.concat(F.lit("account_class:"), account_class(raw), F.lit(":"), t)
    if kind == "ip":
        return F.concat(F.lit("ip_class:"), ip_class(raw), F.lit(":"), t)
    if kind == "process":
        return F.when(known(raw), F.concat(F.lit("semantic_process:"), F.lower(basename(raw)))).otherwise(F.concat(F.lit("semantic_process:other:"), t))
    if kind == "file_path":
        return F.concat(F.lit("semantic_path:"), basename(raw), F.lit(":"), t)
    return t


def pseudonymized(alerts: DataFrame, mode: str = "full", key: Key = TEST_KEY, texts=("command_line",), lists=("relationships",)) -> DataFrame:
    """Every field of FIELDS that is there is rendered, and texts and lists have the row's own raw values replaced. All other columns stay."""
    there = [f for f in FIELDS if f in alerts.columns]
    pairs = F.array(*[pair(F.col(f), rendered(f, F.col(f), mode, key)) for f in there])
    new = {f: rendered(f, F.col(f), mode, key) for f in there}
    new |= {c: replace_ordered(F.col(c), F.col("__pairs")) for c in texts if c in alerts.columns}
    new |= {c: F.transform(c, lambda x: replace_ordered(x, F.col("__pairs"))) for c in lists if c in alerts.columns}
    return alerts.withColumn("__pairs", by_length(pairs)).select(*[new[c].alias(c) if c in new else F.col(c) for c in alerts.columns])


def reverse_map(alerts: DataFrame, mode: str = "full", key: Key = TEST_KEY) -> DataFrame:
    """token, raw: distinct. In hybrid mode a known process has no token and so no entry."""
    entries = []
    for f, kind in FIELDS.items():
        if f in alerts.columns:
            entry = pair(token(kind, F.col(f), key), F.col(f))
            entries.append(F.when(known(F.col(f)), F.lit(None)).otherwise(entry) if mode == "hybrid" and kind == "process" else entry)
    found = alerts.select(F.explode(F.array(*entries)).alias("e")).where("e is not null and e.v is not null")
    return found.select(F.col("e.k").alias("token"), F.col("e.v").alias("raw")).distinct()


#: A reverse map of at most so many tokens (of about 150 bytes) is broadcast.
SMALL_MAP = 100_000


def restored(df: DataFrame, column: str, reverse: DataFrame, key_columns: list[str]) -> DataFrame:
    """df with the tokens in a text column replaced by their raw values. key_columns identify a row. A map of up to SMALL_MAP tokens is counted and broadcast, so that a token that most rows hold is no task's burden; a larger one is met by an equi-join, whose skewed partitions adaptive execution splits."""
    if reverse.limit(SMALL_MAP + 1).count() <= SMALL_MAP:
        reverse = F.broadcast(reverse)
    met = df.select(*key_columns, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0)))).alias("token"))
    pairs = met.join(reverse, "token").groupBy(*key_columns).agg(F.collect_list(pair(F.col("token"), F.col("raw"))).alias("__pairs"))
    out = df.join(pairs, key_columns, "left")
    return out.withColumn(column, F.when(F.col("__pairs").isNull(), F.col(column)).otherwise(restore(F.col(column), F.col("__pairs")))).drop("__pairs")
