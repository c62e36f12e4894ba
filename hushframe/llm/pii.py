"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from four patterns with checks (mail address, IPv4 address, card number by Luhn, international phone number). The model then adds what has the look of such data but not the exact form: phone numbers without a plus sign, mail addresses with a spelled or bracketed "at" and "dot", addresses and cards with other marks between their numbers, numbers that fail a check. It is written in numpy: characters become classes, two LSTMs read a window forwards and backwards, a linear layer gives a score for each tag, and a CRF has learnt transitions between tags.

Windows of WINDOW characters are laid over the whole text, whatever stands in it, each STEP after the one before, and a character takes its scores from the window in whose middle it stands most. These scores are one chain over the whole text, with "none" before and after, and the best tag sequence of that chain is found exactly: a stretch of other tags must gain more by its scores than its transitions cost at least, so what no such stretch can hold (two running sums tell) is "none" in the best sequence, the chain falls apart there, and only the short runs in between are decoded. An added span must keep clear of base spans, must be sure (SURE for each of its characters, as the CRF's probability within its stretch) and must pass its kind's loose check on a normal form.

The model is trained on labelled spans: of a bounded sample of the rows (SAMPLE rows with a digit or an @, whole texts, first in a seeded hash order), labelled by the look (the patterns without Luhn's and the range check), and of GENERATED sentences made of the sample's words and of data in more forms than the patterns know. Of very long samples WINDOWS windows train, drawn by seed from all of them.

Cases: a null or empty text has no spans; a very long text is read whole, in slices of windows; rows may repeat, and train once; an empty table gives no rows; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_by_hash, table
from .textbytes import SLICE, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, HIDDEN, SAMPLE, GENERATED, WINDOWS, EPOCHS, SURE, SEED = 256, 224, 16, 150, 1200, 2_500, 7, 0.8, 7
#: Places at both ends of a window that another window stands nearer the middle of.
EDGE = (WINDOW - STEP) // 2
#: Slices of text, read one by one, that are decoded together, but for when so many open places wait; characters that are searched for these at once.
TOGETHER, OPEN, CACHED = 16, 1 << 18, 1 << 14
TRIGGER = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so looking back changes nothing but the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = DIGITS.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(DIGITS.sub("", text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern of a local part, @ and a domain with dots finds from left to right, in time that grows with the text alone."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all base spans, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
    found += [(2, *m.span()) for m in CARD.finditer(text) if is_card(m[0])]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if is_phone(m[0])]


#: Classes of characters: each ASCII character that is no letter or digit, then digit, lower, upper, other.
CLASS = np.full(128, 0, np.int64)
CLASS[48:58], CLASS[97:123], CLASS[65:91] = 1, 2, 3
for _i, _c in enumerate("@.+-() :/_,;="):
    CLASS[ord(_c)] = 4 + _i
CLASSES, TAGS = 17, 1 + len(KINDS)
#: Classes by how frequent they are in prose (lower, blank, other, upper, dot, comma, digit, the rest), and each one's place there, for bytes.translate.
FREQUENT = np.array([2, 10, 0, 3, 5, 14, 1, 7, 8, 9, 11, 12, 4, 6, 13, 15, 16])
RANKS = bytes(np.argsort(FREQUENT).tolist() + [0] * (256 - CLASSES))


def classes(text: str) -> np.ndarray:
    if text.isascii():
        return CLASS[np.frombuffer(text.encode(), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, CLASS[np.minimum(points, 127)], 0)


def windows(size: int) -> int:
    """How many windows, STEP apart from the first character on, cover a text of so many characters."""
    return 1 + max(0, -(-(size - WINDOW) // STEP)) if size else 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Two LSTMs (inputs are classes, so their input weights are a table), a linear layer and CRF scores."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        p = {}
        for d in "fb":
            p[f"{d}x"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            p[f"{d}h"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
        for d in "fb":
            p[f"{d}x"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
        p["o"], p["c"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return cls(p)

    def lstm(self, d: str, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        kind = self.p["o"].dtype
        h, c = np.zeros((len(x), HIDDEN), kind), np.zeros((len(x), HIDDEN), kind)
        out, kept = np.zeros((x.shape[1], len(x), HIDDEN), kind), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = self.p[f"{d}x"][x[:, t]] + h @ self.p[f"{d}h"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            out[t] = h
        return out, kept

    def lstm_back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t, h, c, i, f, o, g, th in reversed(kept):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"{d}x"] += np.eye(CLASSES, dtype=dz.dtype)[x[:, t]].T @ dz
            grad[f"{d}h"] += h.T @ dz
            dh, dc = dz @ self.p[f"{d}h"].T, dc * f

    def emissions(self, x: np.ndarray, keep: bool = True):
        (hf, kf), (hb, kb) = self.lstm("f", x, keep), self.lstm("b", x, keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["o"] + self.p["c"], h, kf, kb

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over all ways to and from each place, and over all sequences."""
        a, b = np.zeros_like(e), np.zeros_like(e)
        t = self.p["t"]
        a[0] = e[0]
        for k in range(1, len(e)):
            a[k] = e[k] + np.logaddexp.reduce(a[k - 1][:, :, None] + t, axis=1)
        for k in range(len(e) - 2, -1, -1):
            b[k] = np.logaddexp.reduce(t + (e[k + 1] + b[k + 1])[:, None, :], axis=2)
        return a, b, np.logaddexp.reduce(a[-1], axis=1)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-likelihood of the tags y."""
        e, h, kf, kb = self.emissions(x)
        a, b, z = self.sums(e)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - z[:, None])
        for k in range(1, len(e)):
            both = np.exp(a[k - 1][:, :, None] + self.p["t"] + (e[k] + b[k])[:, None, :] - z[:, None, None])
            grad["t"] += both.sum(axis=0)
            np.add.at(grad["t"], (y[:, k - 1], y[:, k]), -1)
        de[np.arange(len(e))[:, None], np.arange(len(x))[None, :], y.T] -= 1
        grad["o"], grad["c"] = np.einsum("tnh,tnk->hk", h, de), de.sum(axis=(0, 1))
        dh = de @ self.p["o"].T
        self.lstm_back("f", x, kf, dh[:, :, :HIDDEN], grad)
        self.lstm_back("b", x, kb, dh[:, :, HIDDEN:], grad)
        return {k: v / len(x) for k, v in grad.items()}

    def edged(self, e: np.ndarray) -> np.ndarray:
        """Scores (places, sequences, tags) with the transitions from and to "none" at both ends."""
        e = e.copy()
        e[0] += self.p["t"][0]
        e[-1] += self.p["t"][:, 0]
        return e

    def best(self, e: np.ndarray) -> np.ndarray:
        """The best tag sequence for each sequence of scores."""
        total, back = e[0], []
        for k in range(1, len(e)):
            s = total[:, :, None] + self.p["t"]
            back.append(s.argmax(axis=1))
            total = e[k] + s.max(axis=1)
        n = np.arange(e.shape[1])
        tags = np.zeros((e.shape[1], len(e)), np.int64)
        tags[:, -1] = total.argmax(axis=1)
        for k in range(len(e) - 1, 0, -1):
            tags[:, k - 1] = back[k - 1][n, tags[:, k]]
        return tags

    def worthy(self, e: np.ndarray, heads: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of chains that begin at `heads` of the places e and have so many, the numbers of those whose best sequence is not "none" throughout, longest first. All chains take a step at once, and nothing is kept of the steps."""
        order = np.argsort(-size, kind="stable")
        heads, size, t = heads[order], size[order], self.p["t"].astype(float)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0))
        scores = np.ascontiguousarray(e.T)
        total = scores[:, heads] + t[0][:, None]
        none = total[0].copy()
        for k, m in enumerate(live[1:].tolist(), 1):
            more = scores[:, heads[:m] + k]
            total[:, :m] = more + (total[:, None, :m] + t[:, :, None]).max(axis=0)
            none[:m] = more[0] + (none[:m] + t[0, 0])
        return order[(total + t[:, :1]).max(axis=0) > none + t[0, 0]]

    def certainty(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability of each of these tags."""
        a, b, z = self.sums(e)
        return np.take_along_axis(np.exp(a + b - z[:, None]).transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0]

    def decode(self, e: np.ndarray, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence for scores e, and the probability of each of its tags; chains() does the same for many of different lengths. alone: nothing stands before and after; else "none" does."""
        e = e if alone else self.edged(e)
        tags = self.best(e)
        return tags, self.certainty(e, tags)

    @cached_property
    def blanks(self) -> tuple[np.ndarray, np.ndarray]:
        """The backward LSTM's states (outputs doubled) after so many blanks, from none to a window of them. Only of a net that is trained no further."""
        _, kept = self.lstm("b", np.full((1, WINDOW + 1), CLASS[32]))
        return 2 * np.stack([h[0] for _, h, *_ in kept], 1), np.stack([c[0] for _, _, c, *_ in kept], 1)

    def chains(self, e: np.ndarray, heads: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """decode() of chains that begin at `heads` of the places e and have so many, longest first, all taking a step at once: the places in them, tags and probabilities."""
        t = self.p["t"].astype(float)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0)).tolist()
        steps = [np.ascontiguousarray(e[heads[:m] + k].T) for k, m in enumerate(live)]
        sums, total, back = [steps[0] + t[0][:, None]], steps[0] + t[0][:, None], []
        for now in steps[1:]:
            m = now.shape[1]
            ways = total[:, None, :m] + t[:, :, None]
            back.append(ways.argmax(axis=0))
            total[:, :m] = now + ways.max(axis=0)
            sums.append(now + np.logaddexp.reduce(sums[-1][:, None, :m] + t[:, :, None], axis=0))
        tag = (total + t[:, :1]).argmax(axis=0)
        after, every = np.repeat(t[:, :1], len(size), axis=1), np.empty(len(size))
        at, tags, sure = [], [], []
        for k in range(len(steps) - 1, -1, -1):
            m, on, n = live[k], live[k + 1] if k + 1 < len(live) else 0, np.arange(live[k])
            if on:
                tag[:on] = back[k][tag[:on], n[:on]]
                after[:, :on] = np.logaddexp.reduce(t[:, :, None] + (steps[k + 1] + after[:, :on])[None], axis=1)
            every[on:m] = np.logaddexp.reduce(sums[k][:, on:] + after[:, on:m], axis=0)  # these end here
            at.append(heads[:m] + k)
            tags.append(tag[:m].copy())
            sure.append(np.exp(sums[k][tag[:m], n] + after[tag[:m], n] - every[:m]))
        return np.concatenate(at), np.concatenate(tags), np.concatenate(sure)

    def paths(self, e: np.ndarray, heads: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and tags of chains(), without probabilities."""
        t = self.p["t"].astype(float)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0)).tolist()
        scores = np.ascontiguousarray(e.T)
        total, back, turned = scores[:, heads] + t[0][:, None], [], t[:, :, None]
        for k, m in enumerate(live[1:], 1):
            ways = total[:, None, :m] + turned
            back.append(ways.argmax(axis=0))
            np.add(scores[:, heads[:m] + k], ways.max(axis=0), out=total[:, :m])
        tag = (total + t[:, :1]).argmax(axis=0)
        at, tags, n, on = [], [], np.arange(len(size)), 0
        for k in range(len(live) - 1, -1, -1):
            if on:
                tag[:on] = back[k][tag[:on], n[:on]]
            on = live[k]
            at.append(heads[:on] + k)
            tags.append(tag[:on].copy())
        return np.concatenate(at), np.concatenate(tags)

    def read(self, x: np.ndarray, sizes: np.ndarray | None = None, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """emissions() of windows, (places, tags, windows), in single precision and with as little moved about in memory as can be: both LSTMs take their steps side by side, classes and the state before go through one product, and each place's scores are added up as its state is known.

        sizes: how many characters of each window are its own, falling; blanks fill it up, of which the backward LSTM's states are known. begins, ends: the windows that begin and end a text; in others the first and last EDGE places are not asked for. What is beyond a size or not asked for is undefined."""
        n, size = x.shape
        sizes = np.full(n, size) if sizes is None else sizes
        e = np.empty((size, TAGS, n), np.float32)
        e[:] = self.p["c"][:, None]
        # Frequent classes come first, so that a step's product leaves out those from which on none stands in its places.
        x = np.frombuffer(x.astype(np.int8, copy=False).tobytes().translate(RANKS), np.int8).reshape(n, size)
        # A sigmoid is half of one more than the tanh of half; outputs are kept doubled, so halves are in the weights.
        one, half, ws = np.float32(1), np.float32(0.5), []
        for d in "fb":
            ws.append(np.concatenate([self.p[f"{d}h"] * 0.5, self.p[f"{d}x"][FREQUENT]]).T.astype(np.float32))
            ws[-1][: 3 * HIDDEN] *= half
        outs = np.ascontiguousarray(self.p["o"].T * 0.5, np.float32)
        out_f, out_b = np.ascontiguousarray(outs[:, :HIDDEN]), np.ascontiguousarray(outs[:, HIDDEN:])
        # Forward windows stand before `mid` with the longest last, backward ones behind it: those at work are always next to each other.
        turn = slice(None, None, -1) if n and sizes[0] != sizes[-1] else slice(None)
        mid, known, state = n, np.zeros((HIDDEN + CLASSES, 2 * n), np.float32), np.zeros((HIDDEN, 2 * n), np.float32)
        known[:HIDDEN, n:], state[:, n:] = (blank[:, size - sizes] for blank in self.blanks)
        all_z, all_g, all_score = np.empty((4 * HIDDEN, 2 * n), np.float32), np.empty((HIDDEN, 2 * n), np.float32), np.empty((TAGS, 2 * n), np.float32)
        seen = np.concatenate([x[turn].T, x[:, ::-1].T], axis=1)
        most = (seen.max(axis=1) + 1).tolist()  # classes in each step's product
        kinds = np.arange(CLASSES, dtype=np.int8)[:, None]
        live_f = live_b = np.searchsorted(-sizes, -np.arange(size)).tolist()  # windows with a character of their own at each place
        at_f, at_b, before, views, same, same_at = slice(None), slice(None), None, {}, None, -size
        for t, back in enumerate(range(size - 1, -1, -1)):
            if t == size - EDGE and begins is not None:  # only these windows are asked for further places
                at_f, at_b = np.flatnonzero(ends), np.flatnonzero(begins)
                columns = np.append(np.arange(n)[turn][at_f[turn]], n + at_b)
                mid, before, same_at = len(at_f), None, -size
                known, state, seen = (np.take(rows, columns, axis=1) for rows in (known, state, seen))
                live_f, live_b = (np.searchsorted(-sizes[at], -np.arange(size)).tolist() for at in (at_f, at_b))
            first, last = mid - live_f[t], mid + live_b[back]
            if first == last:
                continue
            if (first, last) != before:
                before, views = (first, last), {}
                h, c = known[:HIDDEN, first:last], state[:, first:last]
                z, g = all_z[:, first:last], all_g[:, first:last]
                gates, i, f, o, new = (z[a * HIDDEN : b * HIDDEN] for a, b in ((0, 3), (0, 1), (1, 2), (2, 3), (3, 4)))
                parts = [(w, slice(a, b), all_z[:, a:b]) for w, a, b in zip(ws, (first, mid), (mid, last), strict=True)]
                h_f, h_b, score_f, score_b = known[:HIDDEN, first:mid], known[:HIDDEN, mid:last], all_score[:, first:mid], all_score[:, mid:last]
                on_f, on_b = (slice(m) if isinstance(at, slice) else at[:m] for at, m in ((at_f, mid - first), (at_b, last - mid)))
            k = most[t]
            if k not in views:
                views[k] = known[HIDDEN : HIDDEN + k, first:last], [(w[:, : HIDDEN + k], known[: HIDDEN + k, cols], to) for w, cols, to in parts]
            kind, products = views[k]
            if t - same_at >= 16:  # which class stands where, for some steps at once
                same_at, same = t, np.equal(kinds[: max(most[t : t + 16])], seen[t : t + 16, None])
            np.copyto(kind, same[t - same_at, :k, first:last])
            for w, both, to in products:
                np.matmul(w, both, out=to)
            np.tanh(z, out=z)
            gates += one
            c *= f
            np.multiply(i, new, out=g)
            c += g
            c *= half
            np.tanh(c, out=g)
            np.multiply(o, g, out=h)
            np.matmul(out_f, h_f, out=score_f)
            np.matmul(out_b, h_b, out=score_b)
            e[t][:, on_f] += score_f[:, turn]
            e[back][:, on_b] += score_b
        return e

    def open_places(self, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of places (scores e, texts end to end) those that a stretch of other tags than "none" can hold: the largest sum of gains of a stretch around them makes up for going there and back."""
        t = self.p["t"].astype(float) - float(self.p["t"][0, 0])
        gain = reduce(np.maximum, [e[:, k] for k in range(1, TAGS)]).astype(float)
        gain -= e[:, 0]
        gain += t[1:, 1:].max()
        total = np.cumsum(gain)
        before = np.subtract(total, gain, out=gain)
        if len(offsets) > 2:  # no stretch spans two texts
            apart = np.repeat((2 * max(total.max(), -total.min()) + 1) * np.arange(len(offsets) - 1), np.diff(offsets))
            before -= apart
            total -= apart
        np.minimum.accumulate(before, out=before)
        after = np.maximum.accumulate(total[::-1])[::-1]
        return np.flatnonzero(np.subtract(after, before, out=before) >= t[1:, 1:].max() - t[0, 1:].max() - t[1:, 0].max() - 1e-3)

    def single(self) -> Net:
        return Net({k: v.astype(np.float32) for k, v in self.p.items()})


def cut(text: str, tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text as classes, filled up with blanks, and their tags."""
    count = windows(len(text))
    c = np.append(classes(text), np.full(WINDOW, CLASS[32]))
    y = np.append(tags if tags is not None else np.zeros(len(text), np.int64), np.zeros(WINDOW, np.int64))
    at = np.arange(count)[:, None] * STEP + np.arange(WINDOW)
    return c[at], y[at]


def scores(net: Net, points: np.ndarray, offsets: np.ndarray, most: int = 448) -> np.ndarray:
    """The scores of texts, laid end to end as classes with their offsets: of each place, from the window in whose middle it stands most. Windows of one size are read together, and no place that no score is taken from, but for those that lead up to the others."""
    count = np.array([windows(n) for n in np.diff(offsets).tolist()], np.int64)
    own = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start, end, begins, ends = offsets[own] + k * STEP, offsets[own + 1], k == 0, k == count[own] - 1
    sizes = np.minimum(end - start, WINDOW)
    first, last = np.where(begins, 0, EDGE), np.where(ends, sizes, EDGE + STEP)  # places that take their scores from here
    found = np.empty((TAGS, len(points)), np.float32).T
    laid = np.lib.stride_tricks.sliding_window_view(np.append(points, np.full(WINDOW, CLASS[32], points.dtype)), WINDOW)
    order = np.argsort(-sizes, kind="stable")
    for part in np.split(order, range(most, len(order), most)) if len(order) else ():
        read = net.read(laid[start[part]], sizes[part], begins[part], ends[part])
        e = np.empty((len(part), TAGS, WINDOW), np.float32)
        for k in range(0, WINDOW, 64):  # no more places at once than a cache holds
            e[:, :, k : k + 64] = read[k : k + 64].transpose(2, 1, 0)
        e = e.transpose(0, 2, 1)
        for i, (at, a, b) in enumerate(zip(start[part].tolist(), first[part].tolist(), last[part].tolist(), strict=True)):
            found[at + a : at + b] = e[i, a:b]
    return found


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of as many texts as have at most so many characters together; a longer one stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


#: Tells of places and their tags whose probability is asked for.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def decoded(net: Net, at: np.ndarray, e: np.ndarray, offsets: np.ndarray, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of open places with their scores, those that get another tag than "none", with tag and probability. Of the runs of open places within a text, those whose best sequence is more than "none" are decoded, and those that hold wanted places (all, if None) get probabilities; others' are not a number."""
    if not len(at):
        return at, at, np.zeros(0)
    heads = np.append(True, np.diff(at) > 1)
    heads[np.searchsorted(at, offsets[(offsets > at[0]) & (offsets <= at[-1])])] = True  # a text's end is an end
    heads = np.flatnonzero(heads)
    size = np.diff(np.append(heads, len(at)))
    tags, sure = np.zeros(len(at), np.int64), np.full(len(at), np.nan)
    some = net.worthy(e, heads, size)
    if len(some):
        rows, best = net.paths(e, heads[some], size[some])
        tags[rows] = best
    tagged_ = np.flatnonzero(tags)
    if wanted and len(some):
        asked = np.zeros(len(heads), bool)
        asked[np.searchsorted(heads, tagged_[wanted(at[tagged_], tags[tagged_])], "right") - 1] = True
        some = some[asked[some]]
    if len(some):
        rows, _, likely = net.chains(e, heads[some], size[some])
        sure[rows] = likely
    return at[tagged_], tags[tagged_], sure[tagged_]


def places(net: Net, points: np.ndarray, offsets: np.ndarray, wanted: Wanted | None = None, most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, over texts laid end to end, whose tag in the best sequence is not "none", in order, with tag and probability (see decoded() on wanted ones). Texts are read `most` characters at a time, searched for open places in stretches that caches hold, and decoded when OPEN places have come together: the steps of decoding are as many as the longest run has, however many runs take them."""
    done, waiting, count = [], [], 0

    def decode() -> None:
        done.append(decoded(net, np.concatenate([np.zeros(0, np.int64), *(w[0] for w in waiting)]), np.concatenate([np.zeros((0, TAGS)), *(w[1] for w in waiting)]), offsets, wanted))

    for first, last in stretches(offsets, most):
        begin = offsets[first]
        part = offsets[first : last + 1] - begin
        e = scores(net, points[begin : offsets[last]], part)
        for a, b in stretches(part, CACHED):
            own = e[part[a] : part[b]]
            open_ = net.open_places(own, part[a : b + 1] - part[a]) if len(own) else np.zeros(0, np.int64)
            waiting.append((open_ + (begin + part[a]), own[open_].astype(float)))
            count += len(open_)
        if count >= OPEN:
            decode()
            waiting, count = [], 0
    decode()
    at, tags, sure = (np.concatenate(x) for x in zip(*done, strict=True))
    return at, tags, sure


def tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, a, b in reversed(spans):
        y[a:b] = kind + 1
    return y


#: How much of a generated sentence is data, or looks like it; rows of a training step.
DENSITY, ROWS = 0.35, 16
#: The base patterns before their checks: what data of each kind looks like.
LOOK = (None, re.compile(r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])"), re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"), PHONE)


def looks(text: str) -> list[tuple[int, int, int]]:
    """Spans with the look of data, clear of each other: base spans first."""
    found = base(text)
    for kind, pattern in enumerate(LOOK):
        for m in pattern.finditer(text) if pattern else ():
            if not any(a < m.end() and m.start() < b for _, a, b in found):
                found.append((kind, *m.span()))
    return found


def generated(n: int, rng: random.Random, usual: list[str] = ()) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with labelled data, in the patterns' forms and in others, and with numbers and words that are none. usual: words to make them of, besides made-up ones."""
    def letters(low, high):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))

    def number(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word():
        return rng.choice(usual) if usual and rng.random() < 0.8 else letters(1, 9)

    def email():
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", " . ")])
        local = f"{letters(2, 12)}{rng.choice(['', '.', '_']) if at == '@' else ''}{number(rng.randint(0, 2))}"
        return local + at + dot.join([letters(3, 8), *[letters(3, 9)] * rng.randint(0, 1), rng.choice(["com", "org", "net", "example", "de"])])

    def ip():
        sep = rng.choice([".", ".", "[.]", " . ", "(.)", ","])
        return sep.join(str(rng.randint(0, 255 if rng.random() < 0.8 else 999)) for _ in range(4))

    def card():
        sep = rng.choice(["", "", " ", "-", ".", "/", "  "])
        digits = number(16)
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone():
        area, a, b = number(3), number(3), number(4)
        return rng.choice([f"+1 ({area}) {a}-{b}", f"+{rng.randint(1, 99)} {area} {a} {b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"+1{area}{a}{b}", f"00{rng.randint(1, 99)} {area} {a}{b}", f"0{number(3)}/{number(7)}"])

    def none():
        return rng.choice([number(rng.randint(1, 6)), f"{number(1)}.{number(2)}", f"20{number(2)}-{number(2)}-{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", number(rng.randint(21, 30)), f"{number(2)}:{number(2)}", f"#{number(4)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{word()} at {word()}", f"{word()} dot {word()}", f"@{letters(3, 8)}", f"{number(3)}, {number(3)}, {number(3)}", f"{number(4)} {word()} {number(4)}", f"{number(2)}/{number(2)}/{number(4)}"])

    found = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(10, 44)):
            if rng.random() < DENSITY:
                kind = rng.randrange(6)
                item = (email, ip, card, phone, none, none)[kind]()
                if kind < 4:
                    spans.append((kind, len(text), len(text) + len(item)))
                text += item + rng.choice([" ", ", ", ". ", "\n", " | "])
            else:
                text += word() + rng.choice([" ", " ", " ", " ", ", ", ". ", " | "])
        found.append((text, spans))
    return found


def train(texts: list[str]) -> Net:
    """On the labelled spans of these texts and of generated sentences; the same texts give the same net."""
    rng = random.Random(SEED)
    usual = sorted({w for t in texts for w in t.split()[:2000]})
    rows = [*generated(GENERATED, rng, usual), *((t, looks(t)) for t in texts if t)]
    xs, ys = (np.concatenate(z) for z in zip(*(cut(text, tagged(text, spans)) for text, spans in rows), strict=True))
    draw = np.random.default_rng(SEED)
    some = np.sort(draw.choice(len(xs), min(WINDOWS, len(xs)), replace=False))
    x, y = xs[some], ys[some]
    net = Net.fresh(draw).single()
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    t, steps = 0, EPOCHS * max(1, len(x) // ROWS)
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(len(x)), max(1, len(x) // ROWS)):
            grad = net.step(x[part], y[part])
            size = np.sqrt(sum((g * g).sum() for g in grad.values()))
            t += 1
            rate = 0.02 * (1 - t / (steps + 1))
            for k, g in grad.items():
                g = g * min(1, 20 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


_AT = re.compile(r"\s*(?:[\[({]\s*(?:at|@)\s*[\])}]|\bat\b|@)\s*", re.I)
_DOT = re.compile(r"\s*(?:[\[({]\s*(?:dot|\.)\s*[\])}]|\bdot\b|\.)\s*", re.I)
_MAIL = re.compile(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+")
_APART = re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z]{1,3}[0-9]{1,3}){3}")


def mail_like(text: str) -> bool:
    return bool(_MAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))


def card_like(text: str) -> bool:
    return 13 <= len(DIGITS.sub("", text)) <= 19 and not re.search(r"[^0-9 ./-]", text)


def phone_like(text: str) -> bool:
    return 9 <= len(DIGITS.sub("", text)) <= 15 and not re.search(r"[^0-9 ().+/-]", text) and not _APART.fullmatch(text)


#: A loose check for each kind of an added span.
CHECKS = (mail_like, lambda s: bool(_APART.fullmatch(s)), card_like, phone_like)


def added(texts: list[str], known: list[list[tuple[int, int, int]]], net: Net) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text, clear of the known ones."""
    offsets = np.cumsum([0, *map(len, texts)])
    points = np.concatenate([np.zeros(0, np.int8), *(classes(t).astype(np.int8) for t in texts)])

    def fitting(at: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, int, int, tuple[int, int, int]]]:
        """Runs of tagged places that may be added if they are sure: first and last (exclusive), text's number, span."""
        own = np.searchsorted(offsets, at, "right") - 1
        heads = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(tags) != 0) | (np.diff(own) != 0))) if len(at) else at
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)][: len(heads)], strict=True):
            k, kind = int(own[a]), int(tags[a]) - 1
            text, first = texts[k], int(offsets[k])
            start, end = int(at[a]) - first, int(at[b - 1]) + 1 - first
            while start < end and text[start] in " ,.;:\n|":
                start += 1
            while end > start and text[end - 1] in " ,.;:\n|(-":
                end -= 1
            if end > start and CHECKS[kind](text[start:end]) and not any(s < end and start < e for _, s, e in known[k]):
                if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
                    yield a, b, k, (kind, start, end)

    def wanted(at: np.ndarray, tags: np.ndarray) -> np.ndarray:
        asked = np.zeros(len(at), bool)
        for a, b, *_ in fitting(at, tags):
            asked[a:b] = True
        return asked

    at, tags, sure = places(net, points, offsets, wanted)
    some = ~np.isnan(sure)
    at, tags, sure = at[some], tags[some], sure[some]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b, k, span in fitting(at, tags):
        if sure[a:b].min() >= SURE:
            found[k].append(span)
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most `most` different texts with a digit or an @, whole, by a seeded hash of the text. Only texts whose hash passes the bound are searched for these signs."""
    order = [F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("text")), 4), F.col("text")]
    return [r.text for r in first_by_hash(docs.select("text"), order, most, once=True, where=F.col("text").rlike("[0-9@]")).collect()]


def found(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (base and added), n_added: one row for each row of docs."""
    net = net.single()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "__text", TOGETHER * SLICE):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                spans = [base(t) if TRIGGER.search(t) else [] for t in texts]
                more = added(texts, spans, net)
                counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *counts, pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in spans]), pa.array([written(s + m) for s, m in zip(spans, more, strict=True)]), pa.array([len(m) for m in more], pa.int64()),
                ], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op7_bilstm_crf_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found(docs, train(sample(docs)))
