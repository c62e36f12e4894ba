"""URL filter: a ratio of character language models.

Rules by host and path come first: a rule fits its host and all subdomains of it, for paths that begin with the rule's; of the rules that fit, the longest decides. What no rule decides goes to two variable-order Markov models of characters, one trained on accepted and one on rejected URLs. A character's probability blends all orders up to ORDER by Witten-Bell smoothing: what an order has seen counts as much as it has seen, the rest goes to the next lower order, down to an even share of all bytes. The score is the difference of the two log-likelihoods for each byte, and a URL is blocked above a threshold set on URLs that trained neither model.

The rules' own verdicts are the labels: URLs that a rule allows are accepted, those it blocks rejected. The models see the URL without its scheme and with all digits as one sign, so that page numbers teach them nothing. All distinct URLs that a rule decides are learnt from, whole: in a seeded hash order of each label every fifth sets the threshold, the others train. Tasks count the signs after each context, an aggregation adds the counts up, and the threshold is found by running sums over all distinct scores. Every URL is scored over its whole length. One URL of each label is enough; where a label has no second one to hold out, the threshold is 0.

A model of at most MOST counts goes to all tasks. A larger one stays a table: the URLs, in slices of bounded size, are joined with the counts that their contexts ask for, and each slice is scored by the part of the model that it meets, to the same scores.

Cases: a null URL, or one without "://", has empty host and path, no rule and is scored as it is (a null one as empty); without URLs of both labels every score is 0 and what no rule decides is allowed; a very long URL is read whole; rows may repeat, and a URL trains once; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import buckets_for, count_of, keep, lowered, prefix_sums, scratch, shuffled_by, stay, table
from .textbytes import LOWER, mix, slices

#: (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, SEED = 5, 6
#: Counts of the models that go to each task (24 bytes each); URLs scored at once (bytes); scores that one task runs up.
MOST, PART, RUN = 1 << 20, 1 << 18, 1 << 17
#: Bytes as the models see them: lower case, digits as one, 1 as the end.
SIGN = LOWER.copy()
SIGN[48:58] = 48
END = 1


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lowered(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like net/, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits stays
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The signs of all texts, an end after each, and for each order the hash of the signs before each place. A text's start is part of its contexts."""
    rows = len(offsets) - 1
    size = np.diff(offsets) + 1
    first = np.cumsum(size) - size
    signs = np.full(int(size.sum()), END, np.uint64)
    inside = np.ones(len(signs), bool)
    inside[first + size - 1] = False
    signs[inside] = SIGN[data]
    place = np.arange(len(signs)) - np.repeat(first, size)
    found = [np.zeros(len(signs), np.uint64)]
    for k in range(1, order + 1):
        h = np.full(len(signs), k, np.uint64)
        for i in range(1, k + 1):
            before = np.zeros(len(signs), np.uint64)
            before[i:] = signs[:-i]
            before[place < i] = 0
            h = mix(h ^ (before + np.uint64(257 * i)))
        found.append(h)
    return signs, found


def pairs_of(signs: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of each context with the sign after it."""
    return mix(h ^ (signs + np.uint64(1)))


@dataclass
class Model:
    """For each order the contexts met, sorted, with their occurrences and kinds of next sign, and the (context, sign) pairs met, sorted, with their counts."""

    total: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    pair: list[tuple[np.ndarray, np.ndarray]]

    def log_likelihood(self, signs: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(signs), 1 / 256)
        for h, (known, n, kinds), (pairs, count) in zip(found, self.total, self.pair, strict=True):
            if not len(known):  # in a part of a model
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            met = known[at] == h
            both = pairs_of(signs, h)
            where = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
            c = np.where(pairs[where] == both, count[where], 0) if len(pairs) else 0
            p = np.where(met, (c + kinds[at] * p) / (n[at] + kinds[at]), p)
        return np.log(p)


def counted(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the context of each (context, sign) pair met, the pair, sorted, and its count."""
    signs, found = contexts(data, offsets, order)
    for h in found:
        pairs, first, count = np.unique(pairs_of(signs, h), return_index=True, return_counts=True)
        yield h[first], pairs, count


def train(urls: list[bytes], order: int = ORDER) -> Model:
    total, pair = [], []
    for h, pairs, count in counted(np.frombuffer(b"".join(urls), np.uint8), np.cumsum([0, *map(len, urls)]), order):
        known, inverse = np.unique(h, return_inverse=True)
        total.append((known, np.bincount(inverse, count), np.bincount(inverse)))
        pair.append((pairs, count))
    return Model(total, pair)


@dataclass
class Judge:
    accepted: Model
    rejected: Model
    threshold: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-likelihood as a rejected URL less that as an accepted one, for each byte and the end."""
        signs, found = contexts(data, offsets, ORDER)
        each = self.rejected.log_likelihood(signs, found) - self.accepted.log_likelihood(signs, found)
        size = np.diff(offsets) + 1
        return np.add.reduceat(each, np.cumsum(size) - size) / size


def threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The score that splits the two best, each side with half the weight; the middle between the scores next to it. Of splits equally good, the lowest."""
    score = np.concatenate([accepted, rejected])
    weight = np.repeat([len(rejected), -len(accepted)], [len(accepted), len(rejected)])
    order = np.argsort(score, kind="stable")
    score, gain = score[order], np.cumsum(weight[order])
    ends = np.flatnonzero(np.append(score[1:] > score[:-1], True))
    best = ends[np.argmax(gain[ends])]
    return float(score[best] if best + 1 >= len(score) else (score[best] + score[best + 1]) / 2)


def bare(url: bytes) -> bytes:
    """Without the scheme."""
    return url.partition(b"://")[2] or url


def bare_of(url: str) -> Column:
    """bare() of a column; null counts as empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.expr(f"substring(coalesce({url}, ''), instr(coalesce({url}, ''), '://') + 3)")
    return F.when((F.instr(text, "://") > 0) & (F.length(rest) > 0), rest).otherwise(text)


def fit(rows: list[tuple[bytes, str]]) -> Judge | None:
    """What judged() learns, on one machine, from distinct rows (URL, verdict) in the order of the hash. Four of five train the models, the fifth sets the threshold; a label's only URL trains, and the threshold is then 0."""
    by = {v: [bare(u) for u, w in rows if w == v] for v in ("allow", "block")}
    if not all(by.values()):
        return None
    rests = [by[v][::5] if len(by[v]) > 1 else [] for v in ("allow", "block")]
    judge = Judge(*(train([u for i, u in enumerate(by[v]) if i % 5 or len(by[v]) == 1]) for v in ("allow", "block")), 0.0)
    if all(rests):
        judge.threshold = threshold(*(judge.score(np.frombuffer(b"".join(rest), np.uint8), np.cumsum([0, *map(len, rest)])) for rest in rests))
    return judge


def lessons(base: DataFrame) -> DataFrame:
    """by_rule, bare, held, of (how many the label has): one row for each distinct URL that a rule decides. held: it sets the threshold."""
    once = keep(base.where("by_rule is not null").select("by_rule", "url").distinct(), "url-lessons")
    hashed = once.withColumn("h", shuffled_by(F.lit(SEED), F.col("url"))).withColumn("hb", F.shiftright("h", 60 - buckets_for(once.rows)))
    ranked = prefix_sums(hashed, ["by_rule"], "hb", [F.col("h"), F.col("url")], F.lit(1), "rank")
    return keep(ranked.select("by_rule", bare_of("url").alias("bare"), ((F.col("rank") % 5 == 0) & (F.col("rank_total") > 1)).alias("held"), F.col("rank_total").alias("of")), "url-lessons")


def learnt(train: DataFrame) -> DataFrame:
    """by_rule, what, key, n, kinds: both models from rows (by_rule, bare). what is 2k for a context of order k, which has kinds, and 2k + 1 for a pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in ("allow", "block"):
                own = batch.filter(pc.equal(batch.column("by_rule"), v))
                for _, data, offsets in slices(own, "bare"):
                    for k, (h, pairs, n) in enumerate(counted(data, offsets)):
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(n)), pa.array(np.full(len(n), k, np.int32)), pa.array(h.view(np.int64)), pa.array(pairs.view(np.int64)), pa.array(n)], ["by_rule", "k", "h", "pair", "n"])

    found = train.select("by_rule", "bare").mapInArrow(count, "by_rule string, k int, h bigint, pair bigint, n bigint")
    pairs = keep(found.groupBy("by_rule", "k", "h", "pair").agg(F.sum("n").alias("n")), "url-pairs")
    known = pairs.groupBy("by_rule", "k", "h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    known = known.select("by_rule", F.expr("2 * k").alias("what"), F.col("h").alias("key"), "n", "kinds")
    return keep(known.unionByName(pairs.select("by_rule", F.expr("2 * k + 1").alias("what"), F.col("pair").alias("key"), "n", F.lit(0).cast("bigint").alias("kinds"))), "url-models")


def judge_of(rows: pa.Table | pa.RecordBatch) -> Judge:
    """Models from rows of learnt(), some of them or all; rows may repeat."""

    def model(v: str) -> Model:
        own = rows.filter(pc.equal(rows.column("by_rule"), v))
        what, key, n, kinds = (own.column(c).to_numpy() for c in ("what", "key", "n", "kinds"))
        total, pair = [], []
        for k in range(ORDER + 1):
            for at in (np.flatnonzero(what == 2 * k), np.flatnonzero(what == 2 * k + 1)):
                keys, first = np.unique(key[at].view(np.uint64), return_index=True)
                at = at[first]
                if len(total) == len(pair):
                    total.append((keys, n[at].astype(float), kinds[at]))
                else:
                    pair.append((keys, n[at]))
        return Model(total, pair)

    return Judge(model("allow"), model("block"), 0.0)


def scored(rows: DataFrame, models: DataFrame | None, most: int = MOST) -> DataFrame:
    """rows with a score in place of `bare`; 0 without models. most: with more counts, models are joined in parts."""
    fields = [f for f in rows.schema if f.name != "bare"]
    names, out = [f.name for f in fields], StructType([*fields, StructField("score", DoubleType())])
    if models is None:
        return rows.select(*names, F.lit(0.0).alias("score"))

    def by(judge: Judge, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batch, "bare", PART):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(judge.score(data, offsets))], [*names, "score"])

    if count_of(models) <= most:
        judge = judge_of(models.toArrow())

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from by(judge, batch)

        return rows.mapInArrow(whole, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, _, _ in slices(batch, "bare", PART):
                yield part.append_column("__part", pa.array(np.full(part.num_rows, number)))
                number += 1

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("__part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                for _, data, offsets in slices(batch.slice(first, end - first), "bare", PART):
                    for k, (h, pairs, _) in enumerate(counted(data, offsets)):
                        for what, keys in ((2 * k, np.unique(h)), (2 * k + 1, pairs)):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number[first])), pa.array(np.full(len(keys), what, np.int32)), pa.array(keys.view(np.int64))], ["__part", "what", "key"])

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        judge = judge_of(right)
        return pa.Table.from_batches([b for batch in left.combine_chunks().to_batches() for b in by(judge, batch)])

    stay(models)
    parts = stay(keep(rows.mapInArrow(cut, StructType([*rows.schema, StructField("__part", LongType())])), "url-parts"))
    answers = parts.select("__part", "bare").mapInArrow(asked, "__part bigint, what int, key bigint").join(models, ["what", "key"])
    return parts.groupBy("__part").cogroup(answers.groupBy("__part")).applyInArrow(each, out)


def split(held: DataFrame, run: int = RUN) -> float:
    """threshold() of the rows (by_rule, score), of which both labels have some."""
    n = {r.by_rule: r.n for r in held.groupBy("by_rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("by_rule") == "allow", n["block"]).otherwise(-n["allow"]).cast("bigint")
    scores = keep(held.groupBy("score").agg(F.sum(weight).alias("gain")), "url-scores")
    # Ranges of scores; the number of each is written, so that all that follows sees the same.
    ranges = keep(scores.repartitionByRange(max(1, scores.rows // run), "score").withColumn("range", F.spark_partition_id()), "url-scores")
    best = prefix_sums(ranges, [], "range", [F.col("score")], F.col("gain"), "before").orderBy((F.col("before") + F.col("gain")).desc(), "score").first().score
    above = scores.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best if above is None else (best + above) / 2


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most: int = MOST) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of pages."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("by_rule", verdict)
    with scratch():
        known = lessons(base)
        of = {r.by_rule: r.of for r in known.groupBy("by_rule").agg(F.max("of").alias("of")).collect()}
        models = learnt(known.where(~F.col("held"))) if len(of) == 2 else None
        held = known.where("held").select("by_rule", "bare")
        cut = 0.0
        if models is not None and min(of.values()) > 1:
            with scratch():
                cut = split(keep(scored(held, models, most), "url-held"))
        found = scored(base.withColumn("bare", bare_of("url")).drop("url"), models, most)
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > cut, "block").otherwise("allow")).alias("verdict"), "score")


def op6_markov_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
