"""Toxicity by compression distance.

Three zstandard dictionaries are trained: one on ordinary text, and one on each of two halves of the toxic texts. A window is a run of a few words; windows overlap, one begins at each word. It is compressed with all three, and its margin is the length with the ordinary dictionary less the larger of the two toxic lengths: what only one half knows, like a passage of one document, gains nothing. Long windows vary more than short ones, so a margin is measured in deviations of the margins that windows of the same number of bytes have in ordinary documents, and a document's statistic is the sum of its TOP largest, over its distinct windows with a margin above 0. The threshold comes from calibration: on labelled documents that trained no dictionary, an isotonic fit, weighted to the labels' shares in the table, gives the share of toxic documents at each value of the statistic.

Toxic documents consist mostly of ordinary words, so their dictionaries are trained again in ROUNDS: of a half's windows those stay that the other half's dictionary compresses better than the ordinary one does, by more than all but a small share (the round's) of the windows of ordinary documents. Nothing but compressed lengths chooses them. Documents that repeat others (over 30 % of their runs of three words) train once, and a window that stands in several toxic documents is a shared passage and trains nothing. Each setting of SETTINGS (words in a window, bytes of a toxic dictionary) is learnt, and the one stays that finds most toxic calibration documents at 1 % false alarms, and of equals the one that ranks best.

Learning takes at most SAMPLE labelled rows of each label, whole, those first in a seeded hash order; of their ordinary windows at most ORDINARY_WINDOWS, drawn by seed, train the ordinary dictionary, and those of at most MEASURED ordinary documents that do not train it set the deviations and the rounds' bounds. Identifier, language and source are never read. Scoring reads every whole text, a slice of texts at a time, and compresses each distinct window of a slice once.

Cases: a null or empty text has no window and statistic 0; a text with fewer words than a window is one window; an identifier that is labelled twice counts with its larger label, a null label not at all; repeated rows are scored alike and train once; without labelled texts of both labels every score is 0; an empty table gives no rows; other columns of the input stay as they are, but those that the result adds replace columns of the same names.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .quality import isotonic, remainder
from .shared import first_by_hash, keep, shuffled_by, table
from .textbytes import hashes, slices, spans

SAMPLE, SEED, CUT, TOP = 2000, 3, 0.7, 3
#: Words in a window and bytes of each toxic dictionary.
SETTINGS = ((2, 8_192), (3, 16_384))
#: The share of ordinary windows that a round lets through, and the dictionary's bytes before the first.
ROUNDS, FIRST_BYTES, ORDINARY_BYTES = (0.01, 0.01, 0.01, 0.005, 0.005, 0.003), 65_536, 1_000_000
#: Windows that train the ordinary dictionary; ordinary documents whose windows set the deviations; windows that are compressed in one call.
ORDINARY_WINDOWS, MEASURED, TOGETHER = 400_000, 400, 20_000
#: A word stands between the first two marks; the third ends a window, since zstandard begins no match in the last eight bytes.
OPEN, CLOSE, END = b"\x01", b"\x02", b"\x03" * 8
LONGEST = 96  # bytes of a window, from which on all count as one length
#: Logarithms of the match tables' sizes, for the ordinary and the toxic dictionaries: small tables stay in the processor's cache.
PLAIN, SMALL = 18, 14
_BLANK = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 32 or chr(c) in "\"#$%&()*+,./:;<=>?@[\\]^_`{|}~!" else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


def windows(ws: list[bytes], k: int) -> list[bytes]:
    """The distinct runs of k words, in order; of fewer words the one run of all."""
    if not ws:
        return []
    marked = [OPEN + w + CLOSE for w in ws]
    return list(dict.fromkeys(b"".join(marked[i : i + k]) + END for i in range(max(1, len(ws) - k + 1))))


def together(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """windows() of all texts at once: the marked words end to end, and of each distinct window of each text its first byte, the byte after its last (END comes after) and its text."""
    data = np.frombuffer(_BLANK, np.uint8)[data]
    first, last, row = spans(data, offsets, np.arange(256) == 32)
    size = last - first + 2
    at = np.cumsum(size) - size
    stream = np.full(int(size.sum()), CLOSE[0], np.uint8)
    stream[at] = OPEN[0]
    letters = data[data != 32]
    stream[np.arange(len(letters)) + 2 * np.repeat(np.arange(len(size)), size - 2) + 1] = letters
    count = np.bincount(row, minlength=len(offsets) - 1)
    runs = np.where(count > 0, np.maximum(1, count - k + 1), 0)
    text = np.repeat(np.arange(len(count)), runs)
    head = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + (np.cumsum(count) - count)[text]
    tail = np.minimum(head + k, np.cumsum(count)[text]) - 1
    start, end = at[head], at[tail] + size[tail]
    value = hashes(stream, start, end)
    order = np.lexsort((value, text))
    new = np.append(True, (np.diff(value[order]) != 0) | (np.diff(text[order]) != 0))[: len(order)]
    some = np.sort(order[new])
    return stream, start[some], end[some], text[some]


def compressor(content: bytes, log: int):
    settings = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=4, min_match=6, target_length=64, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=settings)


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or, where these are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=24).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size].rjust(8, END)


def lengths(by, ws: list[bytes]) -> np.ndarray:
    """Compressed lengths, a window each."""
    found = [np.fromiter(map(len, by.multi_compress_to_buffer(ws[i : i + TOGETHER], threads=1)), np.int64) for i in range(0, len(ws), TOGETHER)]
    return np.concatenate([np.zeros(0, np.int64), *found])


def deviations(margin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the margins of ordinary windows for each number of bytes, drawn towards those of all where few are met."""
    some, at = 50, np.minimum(size, LONGEST)
    margin = margin.astype(float)
    n = np.bincount(at, minlength=LONGEST + 1) + some
    whole, square = (margin.mean(), (margin * margin).mean()) if len(margin) else (0.0, 1.0)
    mean = (np.bincount(at, margin, LONGEST + 1) + some * whole) / n
    second = (np.bincount(at, margin * margin, LONGEST + 1) + some * square) / n
    return mean, np.sqrt(np.maximum(0, second - mean * mean)) + 0.5


@dataclass
class Model:
    k: int
    ordinary: bytes
    toxic: tuple[bytes, bytes]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(LONGEST + 1))
    sd: np.ndarray = field(default_factory=lambda: np.ones(LONGEST + 1))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))  # rising values of the statistic
    curve: np.ndarray = field(default_factory=lambda: np.zeros(1))  # and the score from each on

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return self.curve[np.maximum(0, np.searchsorted(self.at, statistic, "right") - 1)]


class Scorer:
    """Statistics of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary, (self.one, self.other) = compressor(model.ordinary, PLAIN), (compressor(t, SMALL) for t in model.toxic)

    def margins(self, ws: list[bytes]) -> np.ndarray:
        """The other half is asked only where the first one gains."""
        plain, one = lengths(self.ordinary, ws), lengths(self.one, ws)
        some = np.flatnonzero(one < plain)
        one[some] = np.maximum(one[some], lengths(self.other, [ws[i] for i in some.tolist()]))
        return plain - one

    def statistic(self, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        return self.statistics(data, np.cumsum([0, *map(len, texts)]))

    def statistics(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts end to end, with their offsets. A margin counts in deviations, and as 0 where the ordinary dictionary is as good."""
        stream, start, end, text = together(data, offsets, self.model.k)
        _, first, place = np.unique(hashes(stream, start, end), return_index=True, return_inverse=True)
        raw = stream.tobytes()
        margin = np.concatenate([np.zeros(0, np.int64), *(self.margins([raw[a:b] + END for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]) for part in np.array_split(first, max(1, len(first) // TOGETHER)))])[place]
        n = np.minimum(end - start + len(END), LONGEST)
        far = np.where(margin > 0, np.maximum(0.0, (margin - self.model.mean[n]) / self.model.sd[n]), 0.0)
        order = np.lexsort((-far, text))
        count = np.bincount(text, minlength=len(offsets) - 1)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        best = order[rank < TOP]
        return np.bincount(text[best], far[best], len(offsets) - 1)


def uncopied(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Texts (as words) without those that mostly repeat earlier ones, and without empty ones."""
    seen: set[int] = set()
    kept = []
    for ws in texts:
        runs = {hash(tuple(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))}
        if ws and len(runs & seen) <= 0.3 * len(runs):
            kept.append(ws)
            seen |= runs
    return kept


def learnt(toxic: list[list[bytes]], ordinary: list[list[bytes]], k: int, size: int) -> Model:
    """The dictionaries, and the deviations of ordinary margins, for windows of k words."""
    rng = random.Random(SEED)
    measured = [w for ws in ordinary[::4][:MEASURED] for w in windows(ws, k)] or [END]
    usual = [w for i, ws in enumerate(ordinary) if i % 4 or len(ordinary) < 4 for w in windows(ws, k)[::k]]
    plain = dictionary(ORDINARY_BYTES, rng.sample(usual, min(len(usual), ORDINARY_WINDOWS)))
    by = compressor(plain, PLAIN)
    parts = [[windows(ws, k) for ws in toxic[h::2]] for h in (0, 1)]
    met = Counter(w for half in parts for ws in half for w in ws)
    parts = [[[w for w in ws if met[w] == 1] for ws in half] for half in parts]
    before, usually = [[lengths(by, ws) for ws in half] for half in parts], lengths(by, measured)
    size_of = np.fromiter(map(len, measured), np.int64, len(measured))
    chosen = [[w for ws in half for w in ws[::k]] for half in parts]
    for number, share in enumerate(ROUNDS):
        found = [[], []]
        for h in (0, 1):
            other = compressor(dictionary(size if number else FIRST_BYTES, chosen[1 - h]), SMALL)
            ordinary_margin = usually - lengths(other, measured)
            mean, sd = deviations(ordinary_margin, size_of)

            def far(margin, sizes, mean=mean, sd=sd):
                at = np.minimum(sizes, LONGEST)
                return (margin - mean[at]) / sd[at]

            bound = np.quantile(far(ordinary_margin, size_of), 1 - share)
            for ws, length in zip(parts[h], before[h], strict=True):
                if ws:
                    ok = far(length - lengths(other, ws), np.fromiter(map(len, ws), np.int64, len(ws))) > bound
                    found[h] += [w for w, x in zip(ws, ok.tolist(), strict=True) if x]
        if min(map(len, found)) < 15:  # too few to train on
            break
        chosen = found
    model = Model(k, plain, tuple(dictionary(size, c or [END]) for c in chosen))
    model.mean, model.sd = deviations(Scorer(model).margins(measured), size_of)
    return model


def ranked(statistic: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a toxic and an ordinary document that the statistic puts in order, a tie as half."""
    kinds, place = np.unique(statistic, return_inverse=True)
    bad, good = np.bincount(place, y, len(kinds)), np.bincount(place, 1 - y, len(kinds))
    return float((bad * (np.cumsum(good) - good / 2)).sum() / max(1, bad.sum() * good.sum()))


def found_at(statistic: np.ndarray, y: np.ndarray, alarms: float = 0.01) -> float:
    """The share of toxic documents above the bound that this share of the ordinary ones is above."""
    if not (y == 0).any() or not (y == 1).any():
        return 0.0
    return float((statistic[y == 1] > np.quantile(statistic[y == 0], 1 - alarms)).mean())


def fit(rows: list[tuple[bytes, int]], total: tuple[float, float] | None = None, settings=SETTINGS) -> Model | None:
    """rows: (text, label). total: how many rows of label 0 and 1 there are in all; by default as many as in rows. Three of four train the dictionaries, the fourth calibrates."""
    rng = random.Random(SEED)
    rows = [(words(t), t, y) for t, y in dict.fromkeys(rows)]
    rng.shuffle(rows)
    train, rest = rows[: len(rows) * 3 // 4], rows[len(rows) * 3 // 4 :] or rows
    toxic, ordinary = (uncopied([ws for ws, _, y in train if y == k]) for k in (1, 0))
    if not toxic or not ordinary:
        return None
    y = np.array([y for _, _, y in rest], float)
    best = None
    for k, size in settings:
        model = learnt(toxic, ordinary, k, size)
        at = Scorer(model).statistic([t for _, t, _ in rest])
        found = (found_at(at, y), ranked(at, y))
        if best is None or found > best[0]:
            best = (found, model, at)
    _, model, at = best
    counts = [max(1, sum(r[2] == k for r in rows)) for k in (0, 1)]
    weight = [s / n for s, n in zip(total or counts, counts, strict=True)]
    weights = np.where(y == 1, weight[1], weight[0])
    model.at, place = np.unique(np.append(at, 0), return_inverse=True)
    place = place[: len(at)]
    model.curve = np.clip(isotonic(np.bincount(place, weights, len(model.at)), np.bincount(place, weights * y, len(model.at))), 0, 1)
    return model


def truth(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(learn)


def shares(labels: DataFrame, label: str, learn: Column) -> tuple[float, float]:
    """How many identifiers that may be learnt from have label 0 and 1."""
    counts = {r.y: r.n for r in truth(labels, label, learn).where("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return float(counts.get(0, 0)), float(counts.get(1, 0))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most `most` rows of each label, by a seeded hash of identifier and text; the driver gets no more than these."""
    h = shuffled_by(F.lit(SEED), F.col("doc_id"))
    chosen = [first_by_hash(truth(labels, label, learn).where(F.col("y") == k), [h, F.col("doc_id")], most) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most rows of two numbers
    texts = keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id"), "toxicity-sample")
    order = [shuffled_by(F.lit(SEED), F.col("doc_id"), F.md5(F.col("text").cast("binary"))), F.col("doc_id"), F.col("text")]
    return [(r.text.encode(), r.y) for k in (0, 1) for r in first_by_hash(texts.where(F.col("y") == k), order, most).collect()]


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or of their columns those to carry) with score, predicted and statistic."""
    docs = docs.drop("score", "predicted", "statistic")
    names = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            for part, data, offsets in slices(batch, text_col):
                at = scorer.statistics(data, offsets) if model else np.zeros(part.num_rows)
                score = model.score(at) if model else np.zeros(part.num_rows)
                part = part.select(names)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(at)], [*names, "score", "predicted", "statistic"])

    schema = StructType([*(docs.schema[c] for c in names), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("statistic", DoubleType())])
    return docs.mapInArrow(run, schema)


def op3_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels, learn = table(spark, sf_dir, "labels"), remainder(3) != 1
    model = fit(sample(docs, labels, "toxic", learn), shares(labels, "toxic", learn))
    return scored(docs, model, carry=["doc_id"]).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", "statistic")
