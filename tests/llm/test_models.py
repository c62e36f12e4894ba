"""Scores on held-out rows, exact round trips, and brute-force versions of the parts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import media, packing, pii, quality, toxicity, urls
from llm_rows import SCHEMA, row
from pyspark.sql import functions as F

# JPEG


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70).flatmap(lambda n: st.binary(min_size=n * 3, max_size=n * 3)), min_size=1, max_size=4))
def test_jpeg_round_trip(parts):
    payloads = [(p * 64)[: len(p) // 3 * media.UNIT] for p in parts]
    files = media.encode(payloads)
    pictures = [media.parse(f) for f in files]
    assert [media.payload(p, s) for p, s in zip(pictures, media.decode(pictures), strict=True)] == payloads


def grey(blocks, wide, high):
    """A grey picture with one scan, no restart markers, runs, ends of blocks and runs of 16."""
    lengths = {s: 8 for s in [*range(12)]}, {(r << 4 | n): 8 for r in range(16) for n in range(1, 9)} | {0x00: 8, 0xF0: 8}
    books = []
    for table in lengths:
        symbols = sorted(table)
        counts = [0] * 16
        counts[7] = len(symbols)
        books.append((counts, symbols, media.canonical(counts, symbols)))
    bits, before = "", 0

    def put(book, symbol, n, v):
        code, size = book[2][symbol]
        v = v if v >= 0 else v + (1 << n) - 1
        return f"{code:0{size}b}" + (f"{v:0{n}b}" if n else "")

    for b in blocks:
        d = int(b[0]) - before
        before = int(b[0])
        bits += put(books[0], abs(d).bit_length(), abs(d).bit_length(), d)
        gap, last = 0, max([0, *np.flatnonzero(b).tolist()])
        for v in b[1 : last + 1].tolist():
            if v == 0:
                gap += 1
                continue
            while gap > 15:
                bits += put(books[1], 0xF0, 0, 0)
                gap -= 16
            bits += put(books[1], gap << 4 | abs(v).bit_length(), abs(v).bit_length(), v)
            gap = 0
        if last < 63:
            bits += put(books[1], 0, 0, 0)
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    tables = b"".join(media.segment(0xC4, bytes([kind, *b[0], *b[1]])) for kind, b in ((0, books[0]), (16, books[1])))
    frame = media.segment(0xC0, bytes([8, 0, 8 * high, 0, 8 * wide, 1, 1, 0x11, 0]))
    return b"\xff\xd8" + media.segment(0xDB, bytes([0, 16] + [1] * 63)) + frame + tables + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_jpeg_without_restart_markers():
    rng = np.random.default_rng(0)
    pictures, truth = [], []
    for wide, high in ((1, 1), (3, 2), (4, 4)):
        blocks = rng.integers(-120, 120, (wide * high, 64)) * (rng.random((wide * high, 64)) < 0.15)
        blocks[:, 0] = rng.integers(-60, 60, len(blocks))
        pictures.append(media.parse(grey(blocks, wide, high)))
        truth.append(blocks)
    for p, found, want in zip(pictures, media.decode(pictures), truth, strict=True):
        assert (found[0] == want).all()
        plane = media.thumbnail(p, found)
        assert plane.shape == (p.height // 8, p.width // 8)
        assert (plane.ravel() == np.clip(want[:, 0] * 2 + 128, 0, 255)).all()


def test_jpeg_damage():
    good = media.encode([b"some text".ljust(media.UNIT * 3)])[0]
    for bad in (b"", good[:50], good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\x00" + good):
        with pytest.raises(ValueError):
            media.decode([media.parse(bad)])


def test_media_of_odd_rows(odd, empty):
    found = media.described(media.stored(odd)).collect()
    assert len(found) == odd.count()
    want = []
    for d, t in odd.select("doc_id", "text").collect():
        raw = (t or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=key) == sorted(want, key=key)
    same = {}
    for r in found:
        assert same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.described(media.stored(empty)).count() == 0


# Packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_against_a_plain_best_fit(items):
    lengths = (8, 16, 64)
    bins, offsets, final = packing.pack(np.array(items, np.int64), lengths)
    contents = {}
    for n, b, o in zip(items, bins.tolist(), offsets.tolist(), strict=True):
        contents.setdefault(b, []).append((o, n))
    assert set(contents) == set(range(len(final)))
    for b, c in contents.items():
        at = 0
        for o, n in sorted(c):
            assert o == at
            at += n
        assert final[b] == min(x for x in lengths if x >= at)
    # The same rule, searched plainly: room that is least, of these the bin opened or filled last; a new bin's length by trial; the cheapest choice of lengths.
    totals = []
    for open_ in ([8], [16], [64], [8, 16], [8, 64], [16, 64], [8, 16, 64]):
        if max(items, default=0) > open_[-1]:
            continue
        rooms, left = [], sorted(items, reverse=True)
        while left:
            n = left.pop(0)
            fits = [r for r, _ in rooms if r >= n]
            if fits:
                k = max(k for k, (r, _) in enumerate(rooms) if r == min(fits))
                room, used = rooms.pop(k)
                rooms.append((room - n, used + n))
                continue
            prices = []
            for x in open_:
                if x >= n:
                    contents = n
                    for m in left:
                        if contents + m <= x:
                            contents += m
                    prices.append((packing.cost(min(y for y in open_ if y >= contents)) / contents, x))
            rooms.append((min(prices)[1] - n, n))
        totals.append(sum(packing.cost(min(x for x in lengths if x >= used)) for _, used in rooms))
    assert total_cost(final) == pytest.approx(min(totals, default=0))


def total_cost(final, **at):
    return sum(packing.cost(int(x), **at) for x in final)


def test_lengths_are_weighed_against_what_is_left():
    """The least length that holds an item is not the one opened where a longer one fills better, and the total is less for it."""
    items = np.random.default_rng(4).integers(20, 900, 600)
    whole = packing.pack(items)[2]
    used = set(whole.tolist())
    assert len(used) > 1 and max(used) > 1024
    least = packing.LENGTHS[1]  # every item fits here: the shortest bin for each, filled best
    assert total_cost(whole) < 0.985 * total_cost(packing.pack(items, (512, least))[2])
    for only in packing.LENGTHS[1:]:
        assert total_cost(whole) <= total_cost(packing.pack(items, (only,))[2])


def cheapest(items, lengths, **at):
    """The least total cost of all ways to pack, by trying them."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(items):
            best[0] = min(best[0], sum(packing.cost(min(x for x in lengths if x >= b), **at) for b in bins))
            return
        for k, b in enumerate(bins):
            if b + items[i] <= max(lengths) and b not in bins[:k]:
                go(i + 1, [*bins[:k], b + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_cheapest_way():
    rng = np.random.default_rng(9)
    lengths, at = (8, 16, 64), dict(overhead=4, quadratic=64)
    ours = theirs = 0.0
    for _ in range(40):
        items = rng.integers(1, 30, 7)
        ours += total_cost(packing.pack(items, lengths, **at)[2], **at)
        theirs += cheapest(items.tolist(), lengths, **at)
    assert theirs <= ours <= 1.1 * theirs


def test_packing_deals_rows_without_identifier(spark):
    rows = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"))
    found = packing.packed(rows, lengths=(16,), rows=500).withColumn("group", F.shiftright("bin_id", 32)).groupBy("group").count().collect()
    assert len(found) == 6 and max(r["count"] for r in found) < 700


def test_packing_whole_table(odd, empty):
    found = packing.packed(odd, lengths=(16, 32, 64), rows=25).collect()
    docs = {}
    for d, t in odd.select("doc_id", "text").collect():
        docs.setdefault(d, []).append(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) + 1)
    for d, sizes in docs.items():
        assert sum(r.piece_tokens for r in found if r.doc_id == d) == sum(sizes)
    bins = {}
    for r in found:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_tokens, r.bin_tokens, r.bin_length))
    for c in bins.values():
        at = 0
        for o, n, total, length in sorted(c):
            assert o == at and n >= 1
            at += n
        assert at == total <= length and length in (16, 32, 64) and (length == 16 or total > length // 2)
    assert packing.packed(empty).count() == 0


# Quality


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(1)
    n, h = rng.integers(0, 20, 40).astype(float), np.zeros(40)
    h = np.array([rng.integers(0, int(k) + 1) for k in n], float)
    found = quality.isotonic(n, h)
    assert (np.diff(found) >= -1e-12).all()
    # min-max formula on the bins that have rows
    rows = np.flatnonzero(n)
    for i in rows:
        want = max(min(h[[x for x in rows if a <= x <= b]].sum() / n[[x for x in rows if a <= x <= b]].sum() for b in rows if b >= i) for a in rows if a <= i)
        assert abs(found[i] - want) < 1e-9


def test_statistics_by_hand():
    texts = ["Aa 1!\nAa 1!", "", "x x x y"]
    raw = [t.encode() for t in texts]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = {k: i for i, k in enumerate(quality.NAMES)}
    assert x[0, at["share_upper"]] == pytest.approx(2 / 11) and x[0, at["distinct_lines"]] == 0.5 and x[0, at["distinct_words"]] == 0.5
    assert x[2, at["repeated_words"]] == 0.5 and x[2, at["top_run"]] == pytest.approx(np.log1p(3)) and x[2, at["distinct_words"]] == 0.5
    assert (x[1, : len(quality._CLASSES)] == 0).all() and x[1, at["log_bytes"]] == 0


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, len(quality.NAMES)))
    phi = quality.fourier(x, np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), features=8192)[:, :-1]
    w, _ = quality.frequencies(features=8192)
    gamma = w.var() / 2
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(phi @ phi.T - kernel).max() < 0.08


def test_quality_learns(spark, words, odd, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        ws = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        good = i % 3 > 0
        text = " ".join(ws).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in ws)
        rows.append(row(i, text))
        labels += [(i, int(good))] * (2 if i % 50 == 0 else 1)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(quality.statistics_of(docs), labels, "quality", quality.remainder(4) != 2)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in got if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97
    table = {r.doc_id: r.score for r in quality.scored_statistics(quality.statistics_of(docs), model).collect()}
    assert all(abs(table[i] - got[i].score) < 1e-9 for i in got)
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, model).collect()) and quality.scored(odd, model).count() == odd.count()
    assert quality.scored(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert quality.scored(empty, model).count() == 0
    none = quality.fit(quality.statistics_of(docs), labels.where("false"), "quality", quality.remainder(4) != 2)
    assert none is None and {r.score for r in quality.scored(odd, None).collect()} == {0.5}


# Toxicity


def test_toxicity_learns(spark, words, odd, empty):
    rng = random.Random(5)
    bad = ["grumblefud", "snarkwort", "bilgeface", "mudbrain"]
    rows, labels = [], []
    for i in range(700):
        ws = [rng.choice(words) for _ in range(rng.randint(15, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad).capitalize())
        rows.append(row(i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.sample(docs, labels, "toxic", quality.remainder(3) != 1))
    got = [r for r in toxicity.scored(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted for r in got if r.doc_id % 5 == 0]) > 0.95 and np.mean([r.predicted for r in got if r.doc_id % 5]) < 0.02
    assert toxicity.scored(odd, model).count() == odd.count() and toxicity.scored(empty, model).count() == 0
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}
    assert toxicity.fit([]) is None and toxicity.fit([(b"a b c", 0)]) is None


def small_model(k=2):
    return toxicity.Model(k, b"\x01plain\x02\x01words\x02\x01here\x02" * 8, (b"\x01grumblefud\x02\x01there\x02\x03\x03" * 8, b"\x01a\x02\x01grumblefud\x02" * 8))


def test_statistics_do_not_depend_on_the_slice(monkeypatch):
    texts = [b"plain words here", b"a grumblefud there grumblefud now", b"Grumblefud, GRUMBLEFUD!", b"", b" . "]
    whole = toxicity.Scorer(small_model()).statistic(texts).tolist()
    monkeypatch.setattr(toxicity, "TOGETHER", 1)
    scorer = toxicity.Scorer(small_model())
    assert [scorer.statistic([t])[0] for t in texts] == whole and whole[1] > 2 and whole[0] == 0 == whole[3] == whole[4]
    assert scorer.statistic([]).tolist() == []


@pytest.mark.parametrize("k", [1, 2, 3])
def test_windows_of_all_texts_at_once(k):
    texts = ["a b a b a b c", "", "One, two!", "x", "é ü é ü", " \t\n", "b a"]
    raw = [t.encode() for t in texts]
    stream, start, end, text = toxicity.together(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), k)
    got = [[bytes(stream[a:b]) + toxicity.END for a, b, t in zip(start, end, text, strict=True) if t == i] for i in range(len(texts))]
    assert got == [toxicity.windows(toxicity.words(t), k) for t in raw]


@pytest.mark.parametrize("k", [2, 3])
def test_statistic_against_plain_compression(k, words):
    """Each window is compressed plainly, by a new compressor, with all three dictionaries."""
    import zstandard

    model = small_model(k)
    rng = random.Random(13)
    model.mean, model.sd = np.linspace(-2, 1, toxicity.LONGEST + 1), np.linspace(0.5, 2, toxicity.LONGEST + 1)

    def length(content, log, window):
        return len(toxicity.compressor(content, log).compress(window)) if content else 0

    for _ in range(4):
        ws = [rng.choice([*words[:20], "grumblefud", "there", "plain", "a"]) for _ in range(rng.randint(1, 14))]
        runs = {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}
        found = []
        for run in runs:
            window = b"".join(b"\x01" + w.encode() + b"\x02" for w in run) + b"\x03" * 8
            plain, one, other = (length(c, log, window) for c, log in ((model.ordinary, toxicity.PLAIN), *((t, toxicity.SMALL) for t in model.toxic)))
            margin, n = plain - max(one, other), min(len(window), toxicity.LONGEST)
            found.append(max(0, (margin - model.mean[n]) / model.sd[n]) if margin > 0 else 0)
        want = sum(sorted(found, reverse=True)[:3])
        assert toxicity.Scorer(model).statistic([" ".join(ws).encode()])[0] == pytest.approx(want)
    assert isinstance(toxicity.compressor(model.ordinary, toxicity.PLAIN), zstandard.ZstdCompressor)


def test_toxicity_odd_rows(spark, words):
    rows = [row(1, None), row(2, ""), row(3, "x " * 40_000), row(4, "grumblefud"), row(4, "grumblefud"), row(None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, None), (4, 1), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    found, total = toxicity.sample(docs, labels, "toxic", F.lit(True)), toxicity.shares(labels, "toxic", F.lit(True))
    assert sorted(found) == [(b"", 0), (b"grumblefud", 1), (b"grumblefud", 1)] and total == (1.0, 2.0)
    got = [(r.doc_id, r.score) for r in toxicity.scored(docs, toxicity.fit(found, total)).collect()]
    assert len(got) == 6 and len({s for d, s in got if d == 4}) == 1 and all(0 <= s <= 1 for _, s in got)
    assert toxicity.sample(docs.where("false"), labels, "toxic", F.lit(True)) == [] and toxicity.shares(labels.where("false"), "toxic", F.lit(True)) == (0.0, 0.0)


def test_ranked_counts_pairs():
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 6, 60).astype(float), (rng.random(60) < 0.3).astype(float)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert toxicity.ranked(s, y) == pytest.approx(np.mean(pairs))


# URLs


def plain_log_likelihood(train, text, order):
    """The blend of all orders, by dictionaries."""
    from collections import Counter, defaultdict

    def signs(u):
        return [int(urls.SIGN[b]) for b in u] + [urls.END]

    counts = defaultdict(Counter)
    for u in train:
        s = signs(u)
        for i, x in enumerate(s):
            for k in range(order + 1):
                counts[k, tuple(([0] * k + s[:i])[len(s[:i]) :][-k:] if k else ())][x] += 1
    total, s = 0.0, signs(text)
    for i, x in enumerate(s):
        p = 1 / 256
        for k in range(order + 1):
            c = counts.get((k, tuple(([0] * k + s[:i])[len(s[:i]) :][-k:] if k else ())))
            if c:
                p = (c[x] + len(c) * p) / (sum(c.values()) + len(c))
        total += np.log(p)
    return total


def test_markov_models_against_dictionaries():
    train = [b"a.example/en/1", b"ab.example/en/22", b"b.example/fr/x", b"casino.example"]
    model = urls.train(train, 3)
    for text in (b"a.example/en/7", b"zzz", b"", b"Casino.example/en"):
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        signs, found = urls.contexts(data, offsets, 3)
        assert model.log_likelihood(signs, found).sum() == pytest.approx(plain_log_likelihood(train, text, 3))


def test_urls(spark):
    rows = [(1, "http://a.b.net/x"), (2, "https://Example.NET/en/1?q=/"), (3, "http://x.example.com/de/"), (4, "http://example.com/fr/"), (5, "ftp://y.org/fr/#a"), (6, None), (7, "no scheme/net/"), (8, "http://net?x"), (9, "http://internet/x"), (10, "a://b.net/c://d.org/fr/"), (11, "http://org/fr/2"), (11, "http://org/fr/2")]
    rows += [(100 + i, f"http://good{i % 7}.org/fr/page/{i}") for i in range(60)] + [(200 + i, f"http://bad{i % 5}.spam.net/win/{i}") for i in range(60)] + [(300, "http://bad1.spam.com/win/1"), (301, "http://good1.example/fr/page/5"), (302, "x" * 30_000)]
    df = spark.createDataFrame([(*r, "h", 0.5) for r in rows], "page_id bigint, url string, host string, score double")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    want = {1: ("a.b.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("x.example.com", "/de/", "example.com/de/", "block"), 5: ("y.org", "/fr/", "org/fr/", "allow"), 10: ("b.net", "/c://d.org/fr/", "net/", "block"), 11: ("org", "/fr/2", "org/fr/", "allow")}
    for k, v in want.items():
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == v
    for k, host, path in ((4, "example.com", "/fr/"), (6, "", ""), (7, "", ""), (8, "net", ""), (9, "internet", "/x")):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, None)
    assert got[300].verdict == "block" and got[301].verdict == "allow"
    assert urls.judged(df).count() == len(rows) and urls.judged(df.where("false")).count() == 0
    assert {r.verdict for r in urls.judged(df.where("page_id in (4, 6, 7)")).collect()} == {"allow"}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_urls_with_few_of_a_label(n):
    judge = urls.fit([(f"http://good{i}.org/fr/page/{i}".encode(), "allow") for i in range(n)] + [(f"http://bad{i}.spam.net/win/{i}".encode(), "block") for i in range(60)])
    text = [b"bad1.spam.com/win/1", b"good1.example/fr/page/5"]
    score = judge.score(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    assert score[0] > judge.threshold >= score[1] and (n > 1 or judge.threshold == 0)
    assert urls.fit([(b"http://a.org/fr/", "allow")] * n) is None


def by_hash(found):
    return sorted(set(found), key=lambda u: (int(hashlib.md5(f"{urls.SEED}:{u}".encode()).hexdigest()[:15], 16), u))


@pytest.mark.parametrize(("n", "most"), [(21_000, urls.MOST), (21_000, 0), (300, 0)])
def test_urls_learn_from_every_ruled_url(spark, n, most):
    """More of a label than were once sampled; with most=0 the models are joined in parts."""
    good = [f"http://good{i % 7}.org/fr/page/{chr(97 + i % 26)}{'é' * (i % 3)}{i:x}" for i in range(n)]
    bad = [f"http://bad{i % 5}.spam.net/win/{chr(97 + i % 11)}{i:o}" for i in range(n // 30)]
    other = ["http://bad1.spam.com/win/1", "http://good1.example/fr/page/5", "", None, "x" * 30_000, "https://\U0001d11e.example/\x00\x01", "http://"]
    judge = urls.fit([(u.encode(), v) for us, v in ((good, "allow"), (bad, "block")) for u in by_hash(us)])
    text = [urls.bare((u or "").encode()) for u in other]
    want = judge.score(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    pages = spark.createDataFrame([(None, u) for u in [*good, *good[:50], *bad]] + list(enumerate(other)), "page_id bigint, url string")
    got = urls.judged(pages, most=most).collect()
    assert len(got) == n + 50 + n // 30 + len(other) and {r.verdict for r in got if r.rule == "org/fr/"} == {"allow"} and {r.verdict for r in got if r.rule == "net/"} == {"block"}
    some = {r.page_id: r for r in got if r.page_id is not None}
    assert [some[i].score for i in range(len(other))] == want.tolist()
    assert [some[i].verdict for i in range(len(other))] == ["block" if s > judge.threshold else "allow" for s in want.tolist()]


@pytest.mark.parametrize("seed", range(4))
def test_url_threshold_in_ranges_of_scores(spark, seed):
    rng = np.random.default_rng(seed)
    accepted, rejected = rng.normal(-1, 1, 300 + seed).round(2 - seed % 2), rng.normal(seed / 2, 1, 200).round(2 - seed % 2)
    held = spark.createDataFrame([("allow", float(s)) for s in accepted] + [("block", float(s)) for s in rejected], "by_rule string, score double")
    want = urls.threshold(accepted, rejected)
    assert urls.split(held, 7) == want == urls.split(held)
    assert urls.split(held.withColumn("score", F.lit(0.5))) == 0.5


# Personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else False, 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+-() aé4", max_size=60))
def test_base_spans_against_plain_patterns(text):
    assert pii.base(text) == plain_base(text)


def test_base_spans_in_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" * 50_000, "1." * 100_000):
        pii.base(text)


def test_gradients():
    rng = np.random.default_rng(0)
    net = pii.Net.fresh(rng)
    net.p["t"] += rng.normal(0, 0.2, net.p["t"].shape)
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))

    def loss():
        e = net.emissions(x)[0]
        gold = sum(e[k, np.arange(3), y[:, k]] for k in range(7)) + sum(net.p["t"][y[:, k - 1], y[:, k]] for k in range(1, 7))
        return (net.sums(e)[2] - gold).mean()

    grad = net.step(x, y)
    for k, v in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)]:
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            down = loss()
            v[at] += 1e-5
            assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_viterbi_against_all_sequences():
    import itertools

    rng = np.random.default_rng(3)
    net = pii.Net.fresh(rng)
    net.p["t"] += rng.normal(0, 1, net.p["t"].shape)
    x = rng.integers(0, pii.CLASSES, (2, 5))
    e = net.emissions(x)[0]
    for alone in (True, False):
        tags, sure = net.decode(e, alone)

        def worth(n, s, alone=alone):
            ends = 0 if alone else net.p["t"][0, s[0]] + net.p["t"][s[-1], 0]
            return ends + sum(e[k, n, s[k]] for k in range(5)) + sum(net.p["t"][a, b] for a, b in zip(s, s[1:], strict=False))

        for n in range(2):
            every = {s: worth(n, s) for s in itertools.product(range(pii.TAGS), repeat=5)}
            assert tuple(tags[n]) == max(every, key=every.get)
            total = np.exp(list(every.values())).sum()
            for k in range(5):
                want = sum(np.exp(v) for s, v in every.items() if s[k] == tags[n, k]) / total
                assert sure[n, k] == pytest.approx(want, rel=1e-6)


@pytest.fixture(scope="module")
def net():
    return pii.train([])


def test_reading_gives_the_scores_of_training(net):
    x = np.random.default_rng(6).integers(0, pii.CLASSES, (5, pii.WINDOW)).astype(np.int8)
    assert np.allclose(net.read(x).transpose(0, 2, 1), net.emissions(x)[0], atol=2e-3)


def chain(net, text):
    """The scores of each character from the window in whose middle it stands most, window by window."""
    best = {}
    for j in range(pii.windows(len(text))):
        first = j * pii.STEP
        part = text[first : first + pii.WINDOW]
        e = net.emissions(pii.classes(part.ljust(pii.WINDOW))[None])[0][:, 0]
        for i in range(len(part)):
            left = i if j else pii.WINDOW
            right = pii.WINDOW - 1 - i if first + pii.WINDOW < len(text) else pii.WINDOW
            if best.get(first + i, (-1, None))[0] < min(left, right) or (best[first + i][0] == min(left, right) and i <= pii.WINDOW // 2):
                best[first + i] = (min(left, right), e[i])
    return np.array([best[i][1] for i in range(len(text))])


def test_whole_texts_are_decoded_as_one_chain(net):
    """Against one Viterbi pass over all characters of each text, with "none" before and after."""
    rng = random.Random(21)
    texts = ["".join(t for t, _ in pii.generated(n, rng)) for n in (1, 4, 9)] + ["", "x", "5" * 700, "word " * 300]
    offsets = np.cumsum([0, *map(len, texts)])
    at, tags, sure = pii.places(net, pii.classes("".join(texts)).astype(np.int8), offsets)
    got = np.zeros(offsets[-1], np.int64)
    got[at] = tags
    for text, first in zip(texts, offsets[:-1].tolist(), strict=True):
        if text:
            want = net.decode(chain(net, text).astype(float)[:, None])[0][0]
            assert got[first : first + len(text)].tolist() == want.tolist()
    assert ((sure > 0) & (sure <= 1 + 1e-9)).all() and len(at) > 200


def test_open_places_with_random_scores():
    rng = np.random.default_rng(8)
    net = pii.Net.fresh(rng)
    for _ in range(30):
        net.p["t"] = rng.normal(0, 2, net.p["t"].shape)
        e = rng.normal(0, 2, (40, pii.TAGS))
        e[:, 0] += 2
        offsets = np.array([0, 0, 13, 40])
        open_ = set(net.open_places(e, offsets).tolist())
        for a, b in zip(offsets, offsets[1:], strict=False):
            if b > a:
                assert {a + i for i in np.flatnonzero(net.decode(e[a:b, None])[0][0])} <= open_


def test_scores_read_no_more_places_than_needed(monkeypatch):
    """Scores of texts around a window's size are those of whole windows, and the net's steps are few more than characters."""
    net = pii.Net.fresh(np.random.default_rng(9)).single()
    rng, steps = random.Random(9), []
    texts = ["".join(rng.choices("ab 7@.-X", k=n)) for n in (1, 2, 15, 16, 17, 0, 224, 239, 240, 241, 255, 256, 257, 479, 480, 481, 900, *[20] * 200)]
    offsets = np.cumsum([0, *map(len, texts)])
    points = pii.classes("".join(texts)).astype(np.int8)
    tanh = np.tanh
    for most in (7, 448):
        got = pii.scores(net, points, offsets, most)
        for text, first in zip(texts, offsets.tolist(), strict=False):
            assert not text or np.allclose(got[first : first + len(text)], chain(net, text), atol=2e-4)
    monkeypatch.setattr(np, "tanh", lambda x, **to: (steps.append(x.shape[1] if x.ndim > 1 and len(x) == 4 * pii.HIDDEN else 0), tanh(x, **to))[1])
    pii.scores(net, points, offsets)
    assert len(points) * 2 <= sum(steps) < len(points) * 2.4


def test_chains_of_all_lengths_take_their_steps_together(monkeypatch):
    rng = np.random.default_rng(10)
    net = pii.Net.fresh(rng)
    net.p["t"] = rng.normal(0, 1, net.p["t"].shape)
    size = np.sort(rng.integers(1, 40, 60))[::-1]
    heads = np.cumsum(size) - size
    e = rng.normal(0, 1, (size.sum(), pii.TAGS))
    e[:, 0] += 2
    want = [net.decode(e[a : a + n, None]) for a, n in zip(heads, size, strict=True)]
    plain = np.array([not t.any() for t, _ in want])
    assert plain.any() and not plain.all() and set(net.worthy(e, heads, size).tolist()) == set(np.flatnonzero(~plain).tolist())
    at, tags, sure = net.chains(e, heads, size)
    order = np.argsort(at)
    assert at[order].tolist() == list(range(size.sum()))
    assert tags[order].tolist() == np.concatenate([t[0] for t, _ in want]).tolist() and np.allclose(sure[order], np.concatenate([s[0] for _, s in want]))

    calls = []
    monkeypatch.setattr(pii.Net, "best", lambda *a: calls.append(1))
    texts = ["call 0%d5 55%d-1234 " % (i % 10, i % 7) * i for i in range(1, 30)]
    at, tags, sure = pii.places(net.single(), pii.classes("".join(texts)).astype(np.int8), np.cumsum([0, *map(len, texts)]))
    assert len(at) and not calls and len(at) == len(tags) == len(sure)


def test_both_directions_take_a_step_together_with_the_classes_there(monkeypatch):
    net = pii.Net.fresh(np.random.default_rng(11)).single()
    points = pii.classes("word Word " * 400).astype(np.int8)
    want = pii.scores(net, points, np.array([0, 4000]))
    assert np.allclose(want, chain(net, "word Word " * 400), atol=2e-4)
    steps, inner, tanh, matmul = [], [], np.tanh, np.matmul
    monkeypatch.setattr(np, "tanh", lambda x, **to: (steps.append(1) if len(x) == 4 * pii.HIDDEN else 0, tanh(x, **to))[1])
    monkeypatch.setattr(np, "matmul", lambda a, b, **to: (inner.append(len(b)), matmul(a, b, **to))[1])
    assert (pii.scores(net, points, np.array([0, 4000])) == want).all()
    assert len(steps) == pii.WINDOW and max(inner) <= pii.HIDDEN + 4


def test_probabilities_only_of_spans_that_may_be_added(monkeypatch, net):
    """Slices are decoded together, to the same tags, and known spans need no probability."""
    rng, asked, chains = random.Random(31), [], pii.Net.chains
    texts = ["".join(t for t, _ in pii.generated(n, rng)) for n in (1, 0, 3, 7, 2)]
    base = [pii.base(t) for t in texts]
    offsets = np.cumsum([0, *map(len, texts)])
    points = pii.classes("".join(texts)).astype(np.int8)
    whole, more = pii.places(net, points, offsets), pii.added(texts, base, net)
    assert any(more) and not np.isnan(whole[2]).any()
    for most, waiting in ((1, 1), (1, 1 << 18), (1 << 20, 1)):
        monkeypatch.setattr(pii, "OPEN", waiting)
        got = pii.places(net, points, offsets, most=most)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all() and np.allclose(got[2], whole[2])
    monkeypatch.setattr(pii.Net, "chains", lambda self, e, heads, size: (asked.append(len(heads)), chains(self, e, heads, size))[1])
    assert pii.added(texts, base, net) == more and asked
    asked.clear()
    mails = ["write to bob.miller@mail.example.com now " * 20]
    assert pii.base(mails[0]) and pii.added(mails, [pii.base(mails[0])], net) == [[]] and not asked
    assert len(pii.places(net, pii.classes(mails[0]).astype(np.int8), np.array([0, len(mails[0])]))[0])


def test_net_on_held_out_sentences(net):
    rows = pii.generated(200, random.Random(77))
    base = [pii.base(t) for t, _ in rows]
    more = pii.added([t for t, _ in rows], base, net)
    want = [{s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in known)} for (_, spans), known in zip(rows, base, strict=True)]
    right = sum(len(w & set(m)) for w, m in zip(want, more, strict=True))
    assert right / sum(map(len, more)) > 0.9 and right / sum(map(len, want)) > 0.6
    plain = [" ".join("".join(random.Random(i * 50 + j).choices("abcdefgh", k=5)) for j in range(50)) for i in range(30)]
    assert not any(pii.added(plain, [[]] * 30, net))


def test_pii_rows(spark, odd, empty, net):
    got = pii.found(odd, net).collect()
    assert len(got) == odd.count() and pii.found(empty, net).count() == 0
    text = "Mail bob.x@mail.example.com or +1 (555) 123-4567; 10.0.0.1 and 4111 1111 1111 1111. é 999.1.1.1"
    (r,) = pii.found(spark.createDataFrame([row(1, text)], SCHEMA), net).collect()
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_base(text))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert set(want.split(",")) <= set(r.spans.split(","))
    for s in set(r.spans.split(",")) - set(want.split(",")):
        a, b = map(int, s.split(":")[1:])
        assert all(b <= x or y <= a for _, x, y in plain_base(text))


def test_pii_of_long_and_repeated_texts(spark, net):
    text = "word é " * 60_000 + "call (555) 123-4567 now " + "word " * 20_000
    got = pii.found(spark.createDataFrame([row(1, text), row(1, text)], SCHEMA), net).collect()
    at = text.index("(555)")
    assert [r.spans for r in got] == [f"phone:{at}:{at + 14}"] * 2 and got[0].n_added == 1 and got[0].n_phone == 0


def test_sample_of_texts(spark):
    rows = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("mail 7 "), (F.col("id") % 400).cast("string")).alias("text"))
    found = pii.sample(rows, 300)
    assert 100 < len(found) == len(set(found)) and pii.sample(rows.where("false"), 300) == []


def test_training_draws_windows_from_the_whole_text(monkeypatch):
    seen = []

    def step(self, x, y):
        seen.append(y)
        return {k: np.zeros_like(v) for k, v in self.p.items()}

    monkeypatch.setattr(pii, "generated", lambda n, rng, usual: [])
    monkeypatch.setattr(pii.Net, "step", step)
    monkeypatch.setattr(pii, "WINDOWS", 10)
    pii.train(["7 word word " * 400 + "bob@mail.example " * 400])
    assert len(seen[0]) == 10 and seen[0].any() and not seen[0].all(axis=1).any()


# The pipeline


def test_pipeline_stages(spark, words, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(160):
        ws = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(ws) if i % 4 else " ".join(w.upper() + "!!" for w in ws), "en", f"s{i % 3}", 0))
        labels.append((i, int(i % 4 > 0)))
    rows += [(1000 + i, rows[1][1].upper() if i % 2 else rows[1][1], "en", "s1", 0) for i in range(6)] + [(2000 + i, rows[5][1] + f" more{i}", "en", None, 0) for i in range(5)] + [(3000, None, None, None, None), (3001, "", "en", "s0", 0)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    good = cp.classify(spark, docs, sf)
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    assert {i for i in range(160) if i % 4} - ids == set() and len({i for i in range(160) if i % 4 == 0} & ids) <= 2
    distinct = cp.drop_copies(spark, docs, sf)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {}
    for r in rows:
        want[(r[1] or "").translate(low)] = max(r[0], want.get((r[1] or "").translate(low), -1))
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(want.values()) and distinct.columns == docs.columns
    near = cp.drop_near_copies(spark, docs, sf)
    left = {r.doc_id for r in near.collect()}
    assert left & {1, *range(1000, 1006)} == {1} and left & {5, *range(2000, 2005)} == {5} and {3000, 3001} <= left and near.columns == docs.columns
    mixed = cp.mix_sources(spark, docs, sf)
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    packed = cp.run(spark, sf).collect()
    assert packed and {r.doc_id for r in packed} <= ids
    assert all(s[1](spark, docs.where("false"), sf).count() == 0 for s in cp.STAGES)


def plain_mix(docs):
    """How often each identifier stands in the mixture, for (doc_id, text, source) numbered as they come."""
    from fractions import Fraction

    from hushframe.llm import mixing

    sized = [(i, d, "z" if s is None else f"s{s}", len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, (d, t, s) in enumerate(docs)]
    names = sorted({k for _, _, k, _ in sized})
    size = {k: sum(n for _, _, x, n in sized if x == k) for k in names}
    weight = {k: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, k in enumerate(names)}
    full: set = set()
    while True:  # what a full source cannot take goes to the others by weight
        rest = [k for k in names if k not in full]
        level = (Fraction(mixing.SHARE) * sum(size.values()) - sum(mixing.MOST * size[k] for k in full)) / sum(weight[k] for k in rest)
        more = {k for k in rest if level * weight[k] > mixing.MOST * size[k]}
        if not more:
            break
        full |= more
    times = {}
    for k in names:
        take, at = int((mixing.MOST * size[k] if k in full else level * weight[k]) + Fraction(1, 2)), 0
        for number in range(mixing.MOST):
            for _, d, n in sorted((hashlib.md5(f"{mixing.SEED}:{number}:{i}".encode()).hexdigest()[:15], d, n) for i, d, x, n in sized if x == k and n):
                if at < take:
                    times[d] = times.get(d, 0) + 1
                at += n
    return times


def test_near_and_mixing_stages_against_plain_versions(spark, words):
    import corpus_pipeline as cp
    from test_near import truth

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 90))), "en", rng.choice(["a", "a", "b", "c", None]), 0) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "b", 0) for i in range(20)] + [(2000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    want = truth([(r[0], r[1]) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == sorted(d for d in want if want[d][1] == d)
    times = {}
    for r in cp.mix_sources(spark, docs, "").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == plain_mix([(r[0], r[1], r[3]) for r in rows]) and set(times.values()) == {1, 2}


def oddly_named(spark, rows):
    """Documents with further columns named as the pipeline's own."""
    return spark.createDataFrame([(*r, f"k{i}", i, -i, 0.25, 7) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string, __row int, __pass int, score double, predicted int")


def test_stages_keep_rows_that_share_identifiers(spark, words, tmp_path):
    """Rows, not identifiers, are judged: of (7, A), (7, B), (3, B and more), (9, A and more) one of each text stays."""
    import corpus_pipeline as cp

    rng = random.Random(17)
    a, b, c = (" ".join(rng.choice(words) for _ in range(70)) for _ in range(3))
    rows = [(7, a, "en", "x", 0), (7, b, "en", "x", 0), (3, b + " end", "en", "y", 0), (9, a + " tail", "en", None, 0), (None, c, "en", "y", 0), (None, c.upper(), None, "y", 0), (None, None, None, None, None), (5, "", "en", "x", 0), (7, a, "en", "x", 0)]
    docs = oddly_named(spark, rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = cp.drop_copies(spark, docs, "")
    assert once.columns == docs.columns
    kept = [((r.text or "").translate(low), r.doc_id, r["__key"]) for r in once.collect()]
    assert sorted(t for t, _, _ in kept) == sorted({(r[1] or "").translate(low) for r in rows})
    assert {t: d for t, d, _ in kept}[""] == 5 and {t: k for t, _, k in kept}[a] in ("k0", "k8")
    near = cp.drop_near_copies(spark, once, "").collect()
    assert sorted((r.text or "")[:20].lower() for r in near) == sorted(["", a[:20], b[:20], c[:20]])
    mixed = cp.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and {r["__key"] for r in mixed.collect()} <= {f"k{i}" for i, r in enumerate(rows) if r[1]}
    spark.createDataFrame([(7, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    good = cp.classify(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {r.score for r in good.collect()} <= {0.25}


def test_pipeline_as_a_whole_against_plain_stages(spark, words, tmp_path):
    """run(): what exact copies, near copies and the mixture leave, by plain versions of them over what the first stage keeps, packed whole."""
    import corpus_pipeline as cp
    from test_near import truth

    rng = random.Random(18)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 90))), "en", rng.choice(["a", "a", "b", None]), 0) for i in range(120)]
    rows += [(1000 + i, rows[i][1].upper(), "en", "b", 0) for i in range(15)] + [(2000 + i, rows[30 + i][1] + " more", "en", "a", 0) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(100)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.classify(spark, docs, str(tmp_path)).count() == len(rows)  # all labels are good
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for r in rows:
        t = r[1].translate(low)
        best[t] = max(best.get(t, -1), r[0])
    left = [r for r in rows if best[r[1].translate(low)] == r[0]]
    groups = truth([(i, r[1]) for i, r in enumerate(left)], 5, 80)
    left = [r for i, r in enumerate(left) if groups[i][1] == i]
    times = plain_mix([(r[0], r[1], r[3]) for r in left])
    want = sorted((d, len(r[1].split()) + 1) for r in left for d, n in times.items() if d == r[0] for _ in range(n))
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, str(tmp_path)).where("piece = 0").collect()) == want


# Models against plain computations


def test_normal_equations_against_one_matrix(spark, words):
    """The sums of the partitions, folds and all, against the equations of one matrix."""
    rng = random.Random(19)
    docs = spark.createDataFrame([row(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) + "!" * (i % 3)) for i in range(300)], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    stats = shared_keep(quality.statistics_of(docs))
    model = quality.fit(stats, labels, "quality", F.lit(True))
    found = sorted((r.doc_id, r.x) for r in stats.collect())
    x, y = np.array([v for _, v in found]), np.array([float(d % 3 > 0) for d, _ in found])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.sd, np.maximum(1e-6, x.std(axis=0)))
    phi = quality.fourier(x, model.mean, model.sd)
    size = quality.FEATURES + 1
    want = np.linalg.solve(phi.T @ phi + quality.RIDGE * len(x) * np.eye(size) / size, phi.T @ y)
    assert np.allclose(phi @ model.weights, phi @ want, atol=1e-5)


def shared_keep(df):
    from hushframe.llm.shared import keep

    return keep(df, "test")


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([row(1, None), row(2, ""), row(3, "x y " * 50_000), row(4, "a b"), row(4, "a b"), row(None, "c")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (3, 0)], "doc_id bigint, quality int")
    model = quality.fit(quality.statistics_of(docs), labels, "quality", F.lit(True))
    got = [(r.doc_id, r.score) for r in quality.scored(docs, model).collect()]
    assert len(got) == 6 and len({s for d, s in got if d == 4}) == 1 and all(0 <= s <= 1 for _, s in got)
    assert quality.fit(quality.statistics_of(docs.where("false")), labels, "quality", F.lit(True)) is None


def test_url_verdicts_against_a_plain_model(spark):
    """Threshold and verdicts by dictionaries: four of five URLs of each label train, the fifth sets the threshold."""
    good = [f"good{i % 4}.org/fr/p{chr(97 + i % 7)}" for i in range(20)]
    bad = [f"win{i % 3}.net/cash{chr(104 + i % 5)}" for i in range(20)]
    rows = [("http://" + u, v) for us, v in ((good, "allow"), (bad, "block")) for u in us]
    judge = urls.fit([(u.encode(), v) for u, v in rows])

    def score(u):
        train = [[x.encode() for i, x in enumerate(us) if i % 5] for us in (good, bad)]
        return (plain_log_likelihood(train[1], u, urls.ORDER) - plain_log_likelihood(train[0], u, urls.ORDER)) / (len(u) + 1)

    held = sorted((score(x.encode()), side) for us, side in ((good[::5], 1), (bad[::5], -1)) for x in us)
    gains = np.cumsum([side for _, side in held])
    k = int(np.argmax(gains))
    assert judge.threshold == pytest.approx((held[k][0] + held[k + 1][0]) / 2)
    test = [b"good9.org/fr/x", b"win8.net/cash", b"", b"other.example/path"]
    data, offsets = np.frombuffer(b"".join(test), np.uint8), np.cumsum([0, *map(len, test)])
    assert judge.score(data, offsets).tolist() == pytest.approx([score(t) for t in test])


def test_null_pages(spark):
    df = spark.createDataFrame([(None, None), (None, "http://a.net/x"), (1, None), (1, "http://b.org/fr/" + "y" * 200_000)], "page_id bigint, url string")
    got = urls.judged(df).collect()
    assert sorted((r.page_id or 0, r.verdict, r.rule) for r in got if r.rule) == [(0, "block", "net/"), (1, "allow", "org/fr/")]
    assert len(got) == 4 and len({(r.verdict, r.score) for r in got if not r.rule}) == 1 and {(r.host, r.path) for r in got if not r.rule} == {("", "")}


def test_media_of_long_and_repeated_texts(spark):
    long = "é—" * 40_000
    got = media.described(media.stored(spark.createDataFrame([row(1, long), row(1, long), row(1, None), row(None, "")], SCHEMA))).collect()
    full = long.encode().ljust(-(-len(long.encode()) // 192) * 192)
    assert sorted(r.payload_sha256 for r in got) == sorted([hashlib.sha256(full).hexdigest()] * 2 + [hashlib.sha256(b" " * 192).hexdigest()] * 2)
