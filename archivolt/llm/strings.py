"""Distinct strings of many texts, in numpy, and what is known of them.

Texts lie in one flat array of code points. Spans of it get two 64-bit hashes, each a
sum of mixed (place, code point) values, so equal spans have equal hashes wherever
they lie; both together stand for the string. ``Store`` keeps the token ids of strings
in sorted arrays by hash, of bounded size. What it holds never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Cells that are mixed at a time, to stay in the cache.
BLOCK = 1 << 15
#: Odd factors of the mixing; fixed values.
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Kinds:
    """What each code point is: white space, letter, number or other. ``ask`` tells of
    one character; each is asked about once."""

    def __init__(self, ask: Callable[[str], int]):
        self.ask, self.table = ask, np.full(0x110000, UNKNOWN, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (missing := np.unique(codes[out == UNKNOWN])).size:
            self.table[missing] = [self.ask(chr(c)) for c in missing.tolist()]
            out = self.table[codes]
        return out


def kinds_of(pieces: Callable[[str], list], single_digits: bool) -> Kinds:
    """The kinds as a pre-tokenizer tells them by the pieces it cuts pairs into."""

    def one(pair: str) -> bool:
        return [span for _, span in pieces(pair)] == [(0, 2)]

    def ask(c: str) -> int:
        if one("a" + c):
            return LETTER
        if one("!" + c):
            return OTHER
        return NUMBER if (pieces(c) if single_digits else one("1" + c)) else SPACE

    return Kinds(ask)


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span; the spans are in order, not empty, and don't overlap. The
    second ones are left out (empty) if not ``both``."""
    one, two = np.empty(len(starts), np.uint64), np.empty(len(starts) if both else 0, np.uint64)
    if not len(starts):
        return one, two
    # the spans that begin in one block of cells
    at = [0, len(starts)]
    if starts[-1] - starts[0] >= BLOCK:
        at = np.unique(np.append(np.searchsorted(starts, np.arange(int(starts[0]), int(starts[-1]) + 1, BLOCK)), len(starts))).tolist()
    for i, j in zip(at[:-1], at[1:], strict=True):
        low, n = int(starts[i]), int(ends[j - 1])
        x = np.arange(low, n, dtype=np.uint64)
        size = np.full(j - i, n - starts[j - 1])
        np.subtract(starts[i + 1 : j], starts[i : j - 1], out=size[:-1])
        x -= np.repeat(starts[i:j].astype(np.uint64), size)
        x <<= np.uint64(21)
        x |= codes[low:n]
        y, first, last = np.empty_like(x), starts[i:j] - low, ends[i:j] - low - 1
        x += M3
        x *= M1
        x ^= np.right_shift(x, np.uint64(30), out=y)
        x *= M2
        x ^= np.right_shift(x, np.uint64(27), out=y)
        # sums of spans are differences of running sums, all modulo 2^64
        np.cumsum(x, out=y)
        one[i:j] = y[last] - y[first] + x[first]
        if both:
            x *= M3
            x ^= np.right_shift(x, np.uint64(31), out=y)
            x *= M1
            x ^= np.right_shift(x, np.uint64(29), out=y)
            np.cumsum(x, out=y)
            two[i:j] = y[last] - y[first] + x[first]
    return one, two


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different pair, in order of ``one``, and each place's pair."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    new = np.r_[True, a[1:] != a[:-1]][: len(a)]
    if (b[1:] != b[:-1])[~new[1:]].any():  # one hash of two strings
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The items of all runs flat[at : at + size] one after another."""
    end = np.cumsum(size)
    if not len(end):
        return flat[:0]
    return flat[np.repeat(at - end + size, size) + np.arange(end[-1])]


class Store:
    """Runs of ids by two hashes. Beyond ``most`` runs, those that weren't asked for
    lately go."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.dtype, self.round = most, dtype, 0
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size, self.used = (np.empty(0, np.int32) for _ in range(3))
        self.flat = np.empty(0, self.dtype)

    def __len__(self) -> int:
        return len(self.one)

    def runs(self, one: np.ndarray, two: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, at and size of each string's run, by the different hashes in order;
        ``learn`` gives ids and sizes of the runs, by place, that aren't here."""
        self.round += 1
        where = np.searchsorted(self.one, one)
        there = np.minimum(where, max(0, len(self) - 1))
        same = self.one[there] == one if len(self) else np.zeros(len(one), bool)
        known = same & (self.two[there] == two) if len(self) else same
        at, size = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        at[known], size[known] = self.at[there[known]], self.size[there[known]]
        self.used[there[known]] = self.round
        flat, fresh = self.flat, np.flatnonzero(~known)
        if len(fresh):
            ids, sizes = learn(fresh)
            size[fresh] = sizes
            at[fresh] = len(flat) + np.cumsum(sizes) - sizes
            flat = np.concatenate([flat, ids.astype(self.dtype)])
            single = np.r_[True, one[1:] != one[:-1]] & ~same
            add = fresh[single[fresh]]
            self.flat, spot = flat, where[add]
            for name, new in (("one", one[add]), ("two", two[add]), ("at", at[add]), ("size", size[add]), ("used", np.full(len(add), self.round))):
                old = getattr(self, name)
                setattr(self, name, np.insert(old, spot, new.astype(old.dtype)))
            if len(self) > self.most:
                self.shrink()
        return flat, at, size

    def shrink(self) -> None:
        keep = self.used > np.partition(self.used, len(self) // 2)[len(self) // 2]
        if not keep.any() or keep.sum() > self.most // 2:
            self.clear()
            return
        for name in ("one", "two", "at", "size", "used"):
            setattr(self, name, getattr(self, name)[keep])
        size = self.size.astype(np.int64)
        self.flat = ragged(self.flat, self.at.astype(np.int64), size)
        self.at = (np.cumsum(size) - size).astype(np.int32)


#: What may follow an apostrophe as one piece.
SINGLE, DOUBLE = "stmd", ("re", "ve", "ll")
SINGLES = np.zeros(128, bool)
SINGLES[[ord(c) for c in SINGLE]] = True


def contracted(codes: np.ndarray, kind: np.ndarray, begins: np.ndarray, cuts: np.ndarray) -> None:
    """Join an apostrophe that is a piece of its own with the letters s, t, m, d, re, ve
    or ll behind it, which begin a piece, but not over ``cuts``; in place. What follows
    begins a piece."""
    n = len(codes)
    at = np.flatnonzero((codes[:-1] == 39) & begins[:-1] & begins[1:] & (kind[1:] == LETTER))
    cut = np.zeros(n + 1, bool)
    cut[cuts] = True
    at = at[~cut[at + 1]]
    if not len(at):
        return
    first = codes[at + 1]
    more = np.minimum(at + 2, n - 1)
    second = np.where((at + 2 < n) & ~begins[more], codes[more], 0)
    short = SINGLES[np.minimum(first, 127)] & (first < 127)
    long = np.zeros(len(at), bool)
    for a, b in DOUBLE:
        long |= (first == ord(a)) & (second == ord(b))
    at, span = at[short | long], np.where(short, 2, 3)[short | long]
    begins[at + 1] = False
    end = at + span
    begins[end[end < n]] = True


def run_starts(kind: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where runs of one kind begin; also at ``cuts``."""
    begins = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[cuts[cuts < len(kind)]] = True
    return begins
