"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted, and a sequence costs overhead + length + length^2 / quadratic: short ones spend their share on the overhead, long ones on attention, so which length is cheapest for a token depends on how well it fills. Items go in order of falling length to the open bin with the least room that still holds them. If none does, a bin is opened. All permitted lengths that hold the item are then weighed jointly against what is left to pack: each is filled, on trial, with the item and the largest remaining items that still fit, one after the other, shrunk to the least permitted length that holds the trial's contents, and priced; the one with the least cost for each token of its contents is opened. At the end every bin shrinks to the least permitted length that holds its contents. All this is done for each choice of lengths that may be opened (of five lengths at most 31), and the choice whose sequences cost least in all is taken: a length that only looks cheap at the moment it is opened is so left out.

Documents are dealt by a hash of their number in the table into groups of about `rows` documents, so that neither missing nor repeated identifiers gather in one group, and each group is packed by itself, in one task's memory; bins are never shared between groups, which costs at most a few open bins for each group. A document longer than the largest length is cut into pieces of that length and a rest. Every token is in exactly one piece.

Cases: a null or empty text is one token (the end mark); a very long text is as many pieces as it takes; repeated rows are documents of their own; items of equal length go in the order of identifiers; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, free, numbered

LENGTHS, OVERHEAD, QUADRATIC, ROWS, SEED = (512, 1024, 2048, 4096, 8192), 64, 32_768, 20_000, 2


def cost(length: int, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    """What a sequence of this length costs to train on, in tokens: linear work, attention's quadratic part, and a fixed part."""
    return overhead + length + length * length / quadratic


def trial(room: int, count: dict[int, int], mask: int) -> int:
    """How much of the room is filled by the largest items that fit, one after the other. count: remaining items of each length; mask has a bit for each of these lengths."""
    filled = 0
    while True:
        size = (mask & ((1 << (room + 1)) - 1)).bit_length() - 1
        if size < 1:
            return filled
        times = min(count[size], room // size)
        filled += times * size
        room = min(room - times * size, size - 1)


def opened(n: int, sizes: list[int], costs: list[float], count: dict[int, int], mask: int) -> int:
    """Of the lengths that hold n, the place of the one whose trial costs least for each token; the shortest of equals."""
    best = None
    for k, size in enumerate(sizes):
        if size >= n:
            contents = n + trial(size - n, count, mask)
            price = next(c for c, x in zip(costs, sizes, strict=True) if x >= contents) / contents
            if best is None or price < best[0]:
                best = (price, k)
    return best[1]


def pack(items: np.ndarray, lengths=LENGTHS, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items (each from 1 to the largest length) the bin and the offset in it; then the length of each bin. Of equally cheap choices of lengths that may be opened the one with fewer, shorter ones."""
    sizes = sorted(lengths)
    if not len(items):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = None
    for many in range(1, len(sizes) + 1):
        for open_ in combinations(sizes, many):
            if open_[-1] >= items.max():
                bins, offsets, used = packed_with(items, list(open_), overhead, quadratic)
                final = np.array(sizes)[np.searchsorted(sizes, used)]
                total = sum(n * cost(c, overhead, quadratic) for c, n in zip(*(x.tolist() for x in np.unique(final, return_counts=True)), strict=True))
                if best is None or total < best[0]:
                    best = (total, bins, offsets, final)
    return best[1:]


def packed_with(items: np.ndarray, sizes: list[int], overhead: int, quadratic: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item with bins of these lengths, and what each bin holds."""
    costs = [cost(c, overhead, quadratic) for c in sizes]
    order = np.argsort(-items, kind="stable")
    kinds, times = np.unique(items, return_counts=True)
    count = dict(zip(kinds.tolist(), times.tolist(), strict=True))
    left = sum(1 << n for n in count)  # bit n is set if an item of length n remains
    rooms: dict[int, list[int]] = {}  # room -> open bins with just that room, the last opened first
    mask = 0  # bit r is set if rooms has a bin with room r
    used: list[int] = []
    bins, offsets = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in order:
        n = int(items[i])
        count[n] -= 1
        if not count[n]:
            left ^= 1 << n
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room = len(used), sizes[opened(n, sizes, costs, count, left)]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(used, np.int64)


def packed(docs: DataFrame, lengths=LENGTHS, rows: int = ROWS, seed: int = SEED, overhead: int = OVERHEAD, quadratic: int = QUADRATIC, id_col: str = "doc_id", text_col: str = "text", tokens=None) -> DataFrame:
    """doc_id, n_tokens, piece, piece_start, piece_tokens, bin_id, bin_length, bin_offset, bin_tokens. tokens: a Column with the number of tokens; by default words and one end mark."""
    most = max(lengths)
    count = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) + 1
    groups = max(1, -(-docs.count() // rows))
    row = free(docs, "__row")
    base = numbered(docs, row).select(F.col(id_col).cast("bigint").alias("doc_id"), F.greatest(count.cast("bigint"), F.lit(1)).alias("n_tokens"), F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(groups)).alias("group"))

    def one(key, part):  # hints would choose another protocol
        part = part.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        tokens = part.column("n_tokens").to_numpy()
        pieces = (tokens + most - 1) // most
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(most, tokens[row] - piece * most)
        bins, offsets, final = pack(size, lengths, overhead, quadratic)
        filled = np.bincount(bins, weights=size, minlength=len(final)).astype(np.int64)
        columns = {
            "doc_id": part.column("doc_id").take(pa.array(row)), "n_tokens": tokens[row], "piece": piece, "piece_start": piece * most, "piece_tokens": size,
            "bin_id": key[0].as_py() * 2**32 + bins, "bin_length": final[bins], "bin_offset": offsets, "bin_tokens": filled[bins],
        }
        return pa.table(columns)

    schema = ", ".join(f"{c} bigint" for c in ("doc_id", "n_tokens", "piece", "piece_start", "piece_tokens", "bin_id", "bin_length", "bin_offset", "bin_tokens"))
    return base.groupBy("group").applyInArrow(one, schema)


def op2_variable_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
