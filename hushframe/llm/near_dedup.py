"""Near-duplicate detection: minhash signatures and a multi-index Hamming join.

A document's set holds its distinct runs of n words. Its signature has POSITIONS minhash values, each cut to 16 bits; two sets with similarity j differ in about (1 - j) POSITIONS of them. `distance` is the least number of differing positions that a pair at the similarity wanted exceeds with a probability below MISS. The join finds every pair of signatures within that distance: positions are split into m chunks, and by the pigeonhole principle, for a distance of m + a, one of the first a + 1 chunks differs in at most one position or one of the others in none. The allowed error of a chunk is enumerated by leaving out each of its positions in turn; two signatures within the distance share at least one such key.

Groups of any size are handled without listing their pairs. Rows with equal sets are one class, with one representative row. Signatures within the distance of the least representative they share a key with, and whatever else is within it across the groups so found, make candidate groups: every similar pair lies inside one of them. For what lies across, keys with up to TILE representatives are joined with themselves; those of larger keys are dealt into slices, and each two slices meet in a cell that returns no more pairs than join the groups it holds. Links are then confirmed on the full sets. Each representative is first tested against one partner, and against one from another group if it has any, so a group of two is always tested; components follow, and in a candidate group only those outside its largest component are left over. These are compared with the whole group in cells, a slice of the left-over against a slice of the group, and a cell returns no more links than it has documents, enough to join what belongs together. A group without a large component so costs comparisons that grow with its square, and copies of its texts in as many cells as it has slices; that is what an exact answer takes where signatures alone cannot tell its members apart.

Where rows or pairs look something up by a key that many share (a class, a group, a partner), keys above a share of all rows are broadcast or salted (shared.joined_to_few), so that no group is one task's work.

Cases: null, empty or blank texts have an empty set and are linked with nothing; a text with fewer than n words has its whole sequence as its only element; a very long text is one slice of its own; rows of one identifier count as one document, linked if any of them is, but for rows with an empty set, which keep their own identifier; repeated rows are in one class; a row without identifier is linked with nothing and kept; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import count_of, free, joined_to_few, keep, numbered, scratch, sieve, stay, table
from .textbytes import LOWER, SLICE, distinct, hashes, mix, shingles, slices, spans

POSITIONS, MISS, SEED, TILE, SALT = 64, 1e-4, 5, 400, 64
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2)


def distance(percent: int, positions: int = POSITIONS, miss: float = MISS) -> int:
    """How many positions may differ so that a pair with a similarity of percent / 100 is missed with a probability below `miss`."""
    p, tail, d = 1 - percent / 100, 1.0, -1
    while tail >= miss:
        d += 1
        tail -= math.comb(positions, d) * p**d * (1 - p) ** (positions - d)
    return d


def layout(most: int, positions: int = POSITIONS) -> list[tuple[int, int, int]]:
    """(start, length, errors) of chunks that find all pairs within `most`: of the splits that leave the longest parts to agree on, the one with the fewest keys."""
    if most == 0:
        return [(0, positions, 0)]
    best = None
    for a in range((most + 1) // 2):  # most = m + a, a + 1 chunks with one error, m - a - 1 without
        m = most - a
        agree = (positions - a - 1) // m
        if agree >= 1 and (best is None or (agree, -a) > (best[0], -best[1])):
            best = (agree, a)
    if best is None:  # one chunk more than errors: one of them is without
        cuts = np.linspace(0, positions, most + 2).astype(int)
        return [(int(s), int(e - s), 0) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e > s]
    agree, a = best
    lengths = [agree + 1] * (a + 1) + [agree] * (most - 2 * a - 1)
    for i in range(positions - sum(lengths)):
        lengths[-1 - i % len(lengths)] += 1
    starts = np.cumsum([0, *lengths])
    return [(int(s), n, 1 if i <= a else 0) for i, (s, n) in enumerate(zip(starts, lengths, strict=False))]


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as hashes, and their owners, sorted by both."""
    data = LOWER[data]
    start, end, row = spans(data, offsets)
    return distinct(*shingles(hashes(data, start, end), row, len(offsets) - 1, n))


def signed(rows: DataFrame, n: int) -> DataFrame:
    """The columns of rows but for text, which are numbers, with n_shingles, k1, k2 (a 128-bit digest of the set) and sig (16 numbers of four positions each)."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                value, owner = sets(data, offsets, n)
                size = np.bincount(owner, minlength=part.num_rows)
                some = np.flatnonzero(size)
                at = (np.cumsum(size) - size)[some]
                sig = np.zeros((part.num_rows, POSITIONS), np.uint64)
                keys = np.zeros((2, part.num_rows), np.uint64)
                if len(some):
                    for i in range(POSITIONS):
                        sig[some, i] = mix(np.minimum.reduceat(value * FACTORS[i] + ADDENDS[i], at)) >> np.uint64(48)
                    keys[0, some] = np.add.reduceat(mix(value ^ FACTORS[0]), at)
                    keys[1, some] = np.bitwise_xor.reduceat(mix(value ^ FACTORS[1]), at)
                lanes = sig.reshape(part.num_rows, -1, 4)
                packed = lanes[..., 0] | lanes[..., 1] << np.uint64(16) | lanes[..., 2] << np.uint64(32) | lanes[..., 3] << np.uint64(48)
                width = POSITIONS // 4
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in names), pa.array(size.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()), pa.array(packed.ravel().view(np.int64))),
                ], [*names, "n_shingles", "k1", "k2", "sig"])

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n_shingles", "k1", "k2"]) + ", sig array<bigint>")


def keyed(classes: DataFrame, chunks: list[tuple[int, int, int]]) -> DataFrame:
    """key, rep, n for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.array(batch.column("sig").flatten()).view(np.uint16).reshape(batch.num_rows, POSITIONS).astype(np.uint64)
            for number, (start, length, errors) in enumerate(chunks):
                found = []
                for left_out in range(length) if errors else (-1,):
                    key = np.full(batch.num_rows, np.uint64(number * 1000 + left_out + 1))
                    for i in range(length):
                        if i != left_out:
                            key = mix(key ^ (sig[:, start + i] + np.uint64(1)))
                    found.append(key.view(np.int64))
                times = len(found)
                at = pa.array(np.tile(np.arange(batch.num_rows), times))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("rep").take(at), batch.column("n").take(at)], ["key", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "key bigint, rep bigint, n bigint")


def differing(a: str, b: str) -> Column:
    """The number of positions in which two signatures differ: of each four in a number, the lower three carry into their top bits where they are not zero, the highest one into the bit above it."""
    total, low, tops = None, F.lit(0x00007FFF7FFF7FFF), F.lit(0x0000800080008000)
    for i in range(POSITIONS // 4):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        three = F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(tops))
        one = F.shiftright(F.shiftrightunsigned(x, 48) + 65535, 16)
        total = three + one if total is None else total + three + one
    return total


def alike(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), distinct and written, those that are similar enough, tested on the full sets of their texts (rep, text). A partner a of many is salted: its text goes to one place for every SALT pairs."""
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near-wanted")
    texts = sieve(texts, "rep", wanted).join(wanted, "rep")
    often = keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "near-often", largest="c")
    salts = F.expr(f"c div {SALT}")
    spread = joined_to_few(pairs, ["a"], often, "c", count_of(pairs)).withColumn("salt", F.pmod(F.xxhash64("b"), salts + 1)).drop("c")
    ta = texts.withColumnsRenamed({"rep": "a", "text": "ta"}).join(often, "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("bigint"), salts)).alias("salt"))
    both = spread.join(ta, ["a", "salt"]).join(texts.withColumnsRenamed({"rep": "b", "text": "tb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *np.add(pc.binary_length(pc.fill_null(batch.column("ta"), "")).to_numpy(), pc.binary_length(pc.fill_null(batch.column("tb"), "")).to_numpy()).tolist()])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, size[first] + SLICE, "right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                (va, oa), (vb, ob) = ((np.concatenate(x) for x in zip(*found, strict=True)) for found in ([(v, o + at) for at, (v, o) in parts(part, c, n)] for c in ("ta", "tb")))
                na, nb = np.bincount(oa, minlength=part.num_rows), np.bincount(ob, minlength=part.num_rows)
                union = distinct(np.concatenate([va, vb]), np.concatenate([oa, ob]))[1]
                union = np.bincount(union, minlength=part.num_rows)
                ok = (100 * (na + nb - union) >= percent * union) & (union > 0)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def parts(batch: pa.RecordBatch, column: str, n: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    at = 0
    for part, data, offsets in slices(batch, column):
        yield at, sets(data, offsets, n)
        at += part.num_rows


def common(value: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many elements each two sets have in common."""
    kinds, column, count = np.unique(value, return_inverse=True, return_counts=True)
    several = count[column] > 1  # an element of one set only is common to none
    column, owner = column[several], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = np.cumsum(np.append(True, np.diff(column[order]) > 0)) - 1, owner[order]
    total = np.diag(np.bincount(owner, minlength=rows)).astype(np.float32) * 0
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        some = np.zeros((rows, 4096), np.float32)
        some[owner[a:b], column[a:b] - first] = 1
        total += some @ some.T
    return total.astype(np.int64)


def forest(ok: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs that are ok, as many as it takes to join the labels that they join."""
    above = {x: x for x in label.tolist()}

    def root(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    found = []
    for i, j in np.argwhere(ok & (label[:, None] != label[None, :]) & np.triu(np.ones(ok.shape, bool))).tolist():
        a, b = root(int(label[i])), root(int(label[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def joined(cells: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between the components met in each cell, from rows (cluster, cell, rep, component, text)."""

    def one(key, rows):
        rows = rows.combine_chunks()
        label = rows.column("component").to_numpy()
        found = []
        if (label != label[0]).any():
            batch = rows.to_batches()[0]
            value, owner = (np.concatenate(x) for x in zip(*((v, o + at) for at, (v, o) in parts(batch, "text", n)), strict=True))
            size = np.bincount(owner, minlength=len(label))
            both = common(value, owner, len(label))
            found = forest(100 * both >= percent * (size[:, None] + size[None, :] - both), label)
        rep = rows.column("rep").to_numpy()
        return pa.table({"a": pa.array([int(rep[i]) for i, _ in found], pa.int64()), "b": pa.array([int(rep[j]) for _, j in found], pa.int64())})

    return cells.groupBy("cluster", "cell").applyInArrow(one, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for the nodes of edges (a, b): large stars and small stars in turn until each component is one star, its least id in the middle. Each round is written to the shared folder; the driver sees one number a round."""
    with scratch():
        return stay(keep(stars_of(edges), "components"))


def stars_of(edges: DataFrame) -> DataFrame:
    """components(), still to be written."""
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct(), "star")


def tiled(slices_: Column, own: Column) -> Column:
    """The cells, numbered first * slices + second, in which a slice meets each slice."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), slices_ - 1), lambda x: F.least(x, own) * slices_ + F.greatest(x, own))


def met(cells: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) between the groups c met in each cell (key, cell) of rows (rep, n, c, sig): signatures within the distance, sizes that allow the similarity, as many as join the groups that are joined."""

    def one(key, rows):
        rows = rows.combine_chunks()
        n, c, rep = (rows.column(x).to_numpy() for x in ("n", "c", "rep"))
        pairs = []
        if (c != c[0]).any():
            sig = np.array(rows.column("sig").combine_chunks().flatten()).view(np.uint16).reshape(len(n), POSITIONS)
            near = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
            for first in range(0, len(n), 64):
                near[first : first + 64] &= (sig[first : first + 64, None, :] != sig[None, :, :]).sum(axis=2) <= most
            pairs = forest(near, c)
        return pa.table({"a": pa.array([int(min(rep[i], rep[j])) for i, j in pairs], pa.int64()), "b": pa.array([int(max(rep[i], rep[j])) for i, j in pairs], pa.int64())})

    return cells.groupBy("key", "cell").applyInArrow(one, "a bigint, b bigint")


def across(held: DataFrame, groups: DataFrame, sigs: DataFrame, most: int, percent: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) with a common key and signatures within the distance, but in different groups: all of them for keys of up to `tile` representatives, of others as many as join the same groups."""
    total = count_of(held)
    placed = held.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("holders")).where("low <> high")
    mixed = keep(mixed.select("key", "holders"), "near-mixed-keys", largest="holders")
    if not mixed.rows:
        return mixed.select(F.col("key").alias("a"), F.col("key").alias("b"))
    placed = keep(joined_to_few(placed, ["key"], mixed, "holders", total).join(sigs, "rep"), "near-mixed")
    few, many = placed.where(F.col("holders") <= tile), placed.where(F.col("holders") > tile)
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "c", "sig")]) for x in "ab")
    both = a.join(b, "key").where((F.col("rep_a") < F.col("rep_b")) & (F.col("c_a") != F.col("c_b")) & alike("n_a", "n_b", percent) & (differing("sig_a", "sig_b") <= most))
    both = both.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    if mixed.largest <= tile:
        return both
    slices_ = F.expr(f"(holders + {tile - 1}) div {tile}")
    cells = many.select("key", "rep", "n", "c", "sig", F.explode(tiled(slices_, F.pmod(F.xxhash64("rep"), slices_))).alias("cell"))
    return both.unionByName(met(cells, most, percent)).distinct()


def left_over(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """cluster, cell, rep, component: the cells of each cluster with several components. Those outside the largest one are dealt into slices, all members into others, and cell (i, j) holds slice i of the former and slice j of the latter. A cluster of two has been tested already."""
    parts_ = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"))
    clusters = parts_.groupBy("cluster").agg(F.max_by("component", F.struct("c", (-F.col("component")).alias("o"))).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1 and size > 2")
    clusters = keep(clusters.select("cluster", "main", "size", F.expr(f"(size - most + {tile - 1}) div {tile}").alias("down"), F.expr(f"(size + {tile - 1}) div {tile}").alias("over")), "near-clusters", largest="size")
    rows = joined_to_few(placed, ["cluster"], clusters, "size", count_of(placed))
    i, j = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("down")), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("over"))
    as_member = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("down") - 1), lambda x: x * F.col("over") + j)
    as_left = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("over") - 1), lambda x: i * F.col("over") + x)
    cells = F.when(F.col("component") == F.col("main"), as_member).otherwise(F.array_union(as_member, as_left))
    return rows.select("cluster", "rep", "component", F.explode(cells).alias("cell"))


CLASS = ["n_shingles", "k1", "k2"]


def same_document(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame | None:
    """Pairs (a, b) of representatives whose classes hold rows of one identifier; None where no identifier is repeated."""
    often = keep(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "near-repeated", largest="times")
    if not often.rows:
        return None
    mine = joined_to_few(rows.select("doc_id", *CLASS), ["doc_id"], often, "times", total).groupBy("doc_id", *CLASS).agg(F.count(F.lit(1)).alias("copies"))
    mine = keep(mine.join(classes.select(*CLASS, "rep"), CLASS).select("doc_id", "rep"), "near-owned")
    first = keep(mine.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("kinds")), "near-first", largest="kinds")
    return joined_to_few(mine, ["doc_id"], first, "kinds", total).where("a <> rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_id: one row for each row of docs. row: a column with a number for each row that every read finds again, as shared.numbered() gives; without it rows are numbered here."""
    most = distance(percent)
    if row is None:
        row = free(docs, "__row")
        docs = numbered(docs, row)
    texts = docs.select(F.col(row).alias("rep"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch():
        rows = stay(keep(signed(texts, n), "near-signed"))
        texts = texts.select("rep", "text")
        in_class = rows.where("doc_id is not null and n_shingles > 0")
        classes = in_class.groupBy(*CLASS).agg(F.min("rep").alias("rep"), F.first("sig").alias("sig"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
        classes = keep(classes.withColumn("n", F.col("n_shingles")), "near-classes", largest="members")
        total = rows.rows
        keys = keyed(classes, layout(most))
        shared = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("p.rep").alias("p"), F.col("p.n").alias("pn"))
        held = keep(keys.join(shared, "key"), "near-held")
        sigs = classes.select("rep", "sig")

        def near(pairs: DataFrame) -> DataFrame:
            """Pairs (a, b) whose signatures are within the distance."""
            pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
            return pairs.where(differing("sa", "sb") <= most).select("a", "b").distinct()

        stars = keep(near(held.where("rep <> p").where(alike("n", "pn", percent)).select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()), "near-stars")
        groups = components(stars)
        rest = keep(across(held, groups, sigs, most, percent, TILE), "near-rest")
        if rest.rows:
            groups = components(stars.unionByName(rest))

        tested = keep(stars.groupBy("b").agg(F.min("a").alias("a")).unionByName(rest.groupBy("b").agg(F.min("a").alias("a"))).select("a", "b").distinct(), "near-tested")
        links = keep(confirmed(tested, texts, n, percent), "near-links")
        linked_to = components(links)
        placed = groups.withColumnRenamed("component", "cluster").join(linked_to, "id", "left").select("cluster", F.col("id").alias("rep"), F.coalesce("component", "id").alias("component"))
        cells = keep(left_over(keep(placed, "near-placed"), TILE), "near-cells")
        more = []
        if cells.rows:
            wanted = keep(cells.select("rep").distinct(), "near-wanted")
            cells = cells.join(sieve(texts, "rep", wanted).join(wanted, "rep"), "rep")
            more.append(keep(joined(cells, n, percent), "near-joined"))
        same = same_document(in_class, classes, total)
        if same is not None:
            more.append(same)
        found = components(reduce(DataFrame.unionByName, more, links)) if more else linked_to
        found = keep(found.withColumnRenamed("id", "rep").join(classes.select("rep", "least"), "rep"), "near-found")

        # The least identifier of each component, then of each class, then of each row.
        least = keep(found.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("kinds")), "near-least", largest="kinds")
        linked = joined_to_few(found.select("rep", "component"), ["component"], least, "kinds", total).select("rep", "component_id")
        by_class = classes.select(*CLASS, "rep", "least", "members").join(linked, "rep", "left")
        by_class = stay(keep(by_class.select(*CLASS, "members", F.coalesce("component_id", "least").alias("component_id")), "near-by-class", largest="members"))
    out = joined_to_few(in_class.select("doc_id", "rep", *CLASS), CLASS, by_class, "members", total).select("doc_id", "n_shingles", "component_id", F.col("rep").alias("row_id"))
    alone = rows.where("not (doc_id is not null and n_shingles > 0)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("rep").alias("row_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_multi_index_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85).drop("row_id")
