"""Near-duplicate detection against all pairs."""

import random
import re

import numpy as np
import pytest

from hushframe.llm import near_dedup as N
from llm_rows import SCHEMA, row




def sets(docs, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        found[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    return found


def truth(docs, n, percent):
    s = sets(docs, n)
    ids = sorted(s)
    above = {d: d for d in ids}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            union = len(s[a]) + len(s[b]) - both
            if union and 100 * both >= percent * union:
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in ids}


@pytest.fixture(scope="module")
def copies(spark, words):
    """A large group of near copies of all degrees, chains, exact copies, and documents that share a passage."""
    rng = random.Random(2)
    start = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, i = [], 0

    def add(ws):
        nonlocal i
        rows.append(row(i * 7, " ".join(ws)))
        i += 1

    for _ in range(150):
        ws = list(start)
        for _ in range(rng.randint(0, 9)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        add(ws)
    chain = [rng.choice(words) for _ in range(90)]
    for _ in range(30):
        add(chain)
        chain = chain[4:] + [rng.choice(words) for _ in range(4)]
    for _ in range(80):
        add([rng.choice(words) for _ in range(rng.randint(5, 60))] + passage + [rng.choice(words) for _ in range(rng.randint(5, 60))])
    for _ in range(20):
        add([w.upper() for w in start])
    for ws in (["one"], ["one"], ["one", "two"], [], ["One", "Two"]):
        add(ws)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(copies, n, percent, monkeypatch):
    monkeypatch.setattr(N, "TILE", 40)
    docs = [(r.doc_id, r.text) for r in copies.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(copies, n, percent).collect()}
    want = truth(docs, n, percent)
    assert found == want


def test_pair_whose_keys_all_have_a_smaller_dissimilar_holder(spark, words):
    """a and b are similar; each key that they share is also held by a document of a smaller identifier that is similar to neither, so only across() meets the pair, and it is a cluster of two."""
    rng = random.Random(12)
    a = [rng.choice(words) for _ in range(150)]
    b = [*a[:-4], *(rng.choice(words) for _ in range(4))]
    runs = [" ".join(a[i : i + 3]) for i in range(148)]
    sigs = N.signed(spark.createDataFrame([row(i, t) for i, t in enumerate([*runs, " ".join(a)])], SCHEMA).select("doc_id", "text"), 3).orderBy("doc_id").collect()
    sigs = np.array([r.sig for r in sigs]).view(np.uint16).reshape(149, N.POSITIONS)
    least = (sigs[:-1] == sigs[-1]).argmax(axis=0)  # the run that gives a its value in each position
    chunks, rows = N.layout(N.distance(85)), []
    for start, length, errors in chunks:
        for left_out in range(length) if errors else (-1,):
            for _ in range(8):  # a word between the runs makes other runs, which may undercut
                kept = [runs[least[start + i]] for i in range(length) if i != left_out]
                rows.append(row(len(rows), " ".join(x for t in kept for x in (t, rng.choice(words)))))
    assert len(rows) < 1000
    rows += [row(1000, " ".join(a)), row(1001, " ".join(b))]
    df = spark.createDataFrame(rows, SCHEMA)

    signed = N.signed(df.select("doc_id", "text"), 3)
    held = {}
    for r in N.keyed(signed.withColumnRenamed("doc_id", "rep").withColumnRenamed("n_shingles", "n"), chunks).collect():
        held.setdefault(r.key, set()).add(r.rep)
    shared = [reps for reps in held.values() if {1000, 1001} <= reps]
    assert shared and all(min(reps) < 1000 for reps in shared)
    want = truth([(r[0], r[1]) for r in rows if r[0] >= 1000], 3, 85)
    assert want[1001][1] == 1000
    found = {r.doc_id: r.component_id for r in N.near_duplicates(df, 3, 85).where("doc_id >= 1000").collect()}
    assert found == {1000: 1000, 1001: 1000}


def test_rows_of_one_identifier_are_one_document(spark, words):
    rng = random.Random(14)
    texts = {x: " ".join(rng.choice(words) for _ in range(60)) for x in "ABCD"}
    rows = [row(7, texts["A"]), row(7, texts["B"]), row(3, texts["B"]), row(9, texts["A"]), row(11, texts["C"]), row(11, texts["D"]), row(12, texts["D"] + " end"), row(12, None), row(None, texts["A"]), row(7, texts["A"])]
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect())
    assert found == [(-1, 58, -1), (3, 58, 3), (7, 58, 3), (7, 58, 3), (7, 58, 3), (9, 58, 3), (11, 58, 11), (11, 58, 11), (12, 0, 12), (12, 59, 11)]


def test_one_identifier_and_one_group_with_most_rows(spark, words):
    """Groups larger than what is broadcast or salted away: 400 rows of one identifier, 400 near copies of one text."""
    rng = random.Random(15)
    start = [rng.choice(words) for _ in range(100)]
    rows = [row(5, " ".join(rng.choice(words) for _ in range(8))) for _ in range(400)] + [row(1000 + i, " ".join([*start[:95], *(rng.choice(words) for _ in range(5))])) for i in range(400)]
    found = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert found == {(5, 5), *((1000 + i, 1000) for i in range(400))}


def test_cells_of_a_large_key_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(16)
    rows, width = [], N.POSITIONS // 4
    for g in range(12):
        base = rng.integers(0, 1 << 62, width)
        for i in range(8):
            sig = base.copy()
            sig[: rng.integers(0, 5)] ^= 1
            rows.append((1, g * 8 + i, int(rng.integers(90, 110)), g * 8 + i // 3, [int(x) for x in sig]))
    held = spark.createDataFrame([(k, rep, n) for k, rep, n, _, _ in rows], "key bigint, rep bigint, n bigint")
    groups = spark.createDataFrame([(rep, c) for _, rep, _, c, _ in rows], "id bigint, component bigint")
    sigs = spark.createDataFrame([(rep, sig) for _, rep, _, _, sig in rows], "rep bigint, sig array<bigint>")
    whole, cells = ({(r.a, r.b) for r in N.across(held, groups, sigs, 3, 85, tile).collect()} for tile in (1000, 7))

    def closed(pairs):
        above = {rep: c for _, rep, _, c, _ in rows}
        for _ in range(len(rows)):
            for a, b in pairs:
                low, high = sorted((above[a], above[b]))
                above = {k: low if v == high else v for k, v in above.items()}
        return above

    assert whole and cells <= whole and closed(cells) == closed(whole)


def test_odd(odd, empty):
    found = N.near_duplicates(odd, 3, 85).collect()
    assert len(found) == odd.count()
    docs = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    want = truth(docs, 3, 85)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id][1], want[r.doc_id][1] == r.doc_id)
    assert N.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 5, 9, 21, 26, 40, 63])
def test_every_pair_within_the_distance_shares_a_key(spark, most):
    rng = np.random.default_rng(most)
    chunks = N.layout(most)
    assert sum(n for _, n, _ in chunks) == N.POSITIONS
    for _ in range(300):
        differs = np.zeros(N.POSITIONS, bool)
        differs[rng.choice(N.POSITIONS, most, replace=False)] = True
        assert any(differs[s : s + n].sum() <= e for s, n, e in chunks)


def test_cells_hold_all_pairs_with_the_left_over(spark):
    rng = random.Random(3)
    members = [(c, c * 1000 + i, c * 1000 + (0 if rng.random() < 0.6 else i)) for c, size in ((1, 2), (2, 3), (3, 95), (4, 20)) for i in range(size)]
    placed = spark.createDataFrame([*members, (5, 5000, 5000), (5, 5001, 5000), (5, 5002, 5000)], "cluster bigint, rep bigint, component bigint")
    cells = {}
    for r in N.left_over(placed, tile=10).collect():
        cells.setdefault((r.cluster, r.cell), set()).add(r.rep)
    assert not any(c in (1, 5) for c, _ in cells)
    together = {(a, b) for reps in cells.values() for a in reps for b in reps}
    for c in (2, 3, 4):
        mine = [(rep, comp) for k, rep, comp in members if k == c]
        for a, x in mine:
            for b, y in mine:
                assert x == y or (a, b) in together


def test_differing_positions(spark):
    rng = np.random.default_rng(22)
    a = rng.integers(0, 1 << 16, (60, N.POSITIONS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < rng.random((60, 1)), a, rng.choice([0, 1, 0x7FFF, 0x8000, 0xFFFF], a.shape).astype(np.uint16))
    packed = [[[int(x) for x in sig.view(np.int64)] for sig in side] for side in (a, b)]
    rows = spark.createDataFrame(list(zip(range(60), *packed, strict=True)), "i int, sa array<bigint>, sb array<bigint>")
    got = {r.i: r.d for r in rows.select("i", N.differing("sa", "sb").alias("d")).collect()}
    assert got == {i: int((a[i] != b[i]).sum()) for i in range(60)}


def test_hashes_follow_the_words(spark):
    import pyarrow as pa

    texts = ["a bb a", "", "bb a", None, "  a  ", "ab", "a b"]
    (part, data, offsets), = N.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text")
    start, end, rows = N.spans(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["a", "bb", "a", "bb", "a", "a", "ab", "a", "b"]
    assert rows.tolist() == [0, 0, 0, 2, 2, 4, 5, 6, 6]
    h = N.hashes(data, start, end)
    assert h[0] == h[2] == h[4] == h[5] == h[7] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(500 - i, 499 - i) for i in range(40)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    above = {x: x for e in edges for x in e}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    found = N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in found} == {x: root(x) for x, y in above.items() if any(a != b and x in (a, b) for a, b in edges)} and len(found) == len({r.id for r in found})
    assert N.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
