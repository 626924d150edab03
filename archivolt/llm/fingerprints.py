"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text and a base B, the prefix array holds the sums of
c[j] B^j modulo the prime 2^31 - 1; two bases give 62 bits. The difference of two
entries, scaled back by a power of B, is the hash of the span between them, so any
two spans are compared in constant time (``Prefixes.equal``) and the longest common
extension of two places is found by binary search (``Prefixes.extension``).

A fingerprint keeps of this the hash of the whole text; a ladder: 16 bits of the hash
of the prefix and of the suffix of each length in a geometric series; and the length
and hash of every span between anchors. An anchor is where the hash of the next
``WINDOW`` code points is one of the lowest, about every ``STRIDE`` code points, so
texts that share a passage share its anchors, wherever it lies. Spans cover the text.

The likeness of two fingerprints finds by binary search the longest rungs at which the
prefixes and the suffixes agree, and adds up the lengths of the spans that both have
(as often as both have them). The greater of the two, as a share of the longer text,
is a lower bound of what they share: an edit hides one or two spans around it, some
``STRIDE`` code points each, and at the ends a sixth of an octave at most.

Null text is the empty text. Equal texts have equal fingerprints, whatever their
id. Rows are ordered by id, nulls first, then by text; each one's next document is
the following row, the last one's is the first; an only row is its own next. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import IdRanges, bound_batches, shuffle_parts, slices, texts_of

P = (1 << 31) - 1
BASES = (1_000_003, 48_271_639)
#: Code points hashed in one flat array; a longer text is one of its own.
FLAT = 1 << 19
STEPS = 6  # rungs an octave
WINDOW, STRIDE = 12, 128
#: An anchor has none so close before it: repetitive text doesn't fill up with them.
APART = 16


def mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, of values under 2^62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.int64)
    have = 1
    while have < n:  # doubling
        more = min(have, n - have)
        out[have : have + more] = mod(out[:more] * pow(base, have, P))
        have += more
    return out


class Powers:
    """Powers of each base and of its inverse, made longer as needed."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def to(self, n: int) -> Powers:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.up = [powers(b, self.n) for b in BASES]
            self.down = [powers(pow(b, P - 2, P), self.n) for b in BASES]
        return self


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Prefixes:
    """Modular prefix arrays of a sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        p = POWERS.to(self.n + 1)
        # code points plus 1: a text of NULs differs from a shorter one
        self.sums = [np.r_[0, mod(np.cumsum(mod((points + 1) * up[: self.n])))] for up in p.up]

    def span(self, i, j) -> list[np.ndarray]:
        """The hash of each span [i, j), the same wherever it lies, by both bases."""
        return [mod(mod(s[j] - s[i] + P) * d[i]) for s, d in zip(self.sums, POWERS.to(self.n + 1).down, strict=True)]

    def equal(self, i: int, other: Prefixes, k: int, n: int) -> bool:
        return i + n <= self.n and k + n <= other.n and all(a == b for a, b in zip(self.span(np.array(i), np.array(i + n)), other.span(np.array(k), np.array(k + n)), strict=True))

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """The length of the longest common extension from i here and k there."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low


def ladder(n: int) -> np.ndarray:
    """The lengths up to n of the geometric series."""
    if n < 1:
        return np.empty(0, np.int64)
    x = np.unique(np.ceil(2 ** (np.arange(0, STEPS * (n.bit_length() + 1)) / STEPS)).astype(np.int64))
    return x[x <= n]


RUNGS = ladder(1 << 40)


def tags(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    x = (one.astype(np.uint64) << np.uint64(31) | two.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(48)).astype("<u2")


def anchors(flat: Prefixes, doc_of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The anchors in the flat array, none at a document's start."""
    if flat.n < WINDOW:
        return np.empty(0, np.int64)
    at = np.arange(flat.n - WINDOW + 1)
    one = flat.span(at, at + WINDOW)[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.flatnonzero((one >> np.uint64(32)) < np.uint64((1 << 32) // STRIDE))
    low = low[low + WINDOW <= ends[doc_of[low]]]
    apart = np.r_[True, (np.diff(low) > APART) | (doc_of[low[1:]] != doc_of[low[:-1]])][: len(low)]
    return low[apart]


def fingerprint_batch(texts: list[str]) -> list[str]:
    out: list[str] = []
    for a, b in slices([len(t) for t in texts], FLAT):
        sizes = np.array([len(t) for t in texts[a:b]], np.int64)
        flat = Prefixes(code_points("".join(texts[a:b])))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        whole = flat.span(starts, ends)
        rungs = np.searchsorted(RUNGS, sizes, side="right")
        doc = np.repeat(np.arange(b - a), rungs)
        length = RUNGS[np.arange(len(doc)) - np.repeat(np.cumsum(rungs) - rungs, rungs)]
        at, end = starts[doc], ends[doc]
        front, back = tags(*flat.span(at, at + length)).tobytes(), tags(*flat.span(end - length, end)).tobytes()
        marks = (2 * np.cumsum(rungs)).tolist()
        filled = starts[sizes > 0]
        opens = np.union1d(filled, anchors(flat, np.repeat(np.arange(b - a), sizes), ends))
        closes = np.r_[opens[1:], flat.n][: len(opens)]
        spans = np.column_stack([closes - opens, flat.span(opens, closes)[0]]).astype("<u4").tobytes()
        places = (8 * np.searchsorted(opens, np.r_[starts, flat.n])).tolist()
        coded = base64.b64encode
        for n, x, y, i, j, k, m in zip(sizes.tolist(), whole[0].tolist(), whole[1].tolist(), [0, *marks], marks, places, places[1:]):
            out.append(f"{n:x}.{x:08x}{y:08x}.{coded(front[i:j] + back[i:j]).decode()}.{coded(spans[k:m]).decode()}")
    return out


def agreeing(a: memoryview, b: memoryview, n: int) -> int:
    """Rungs at which both agree, of the first n: agreement goes on until it ends."""
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[2 * mid - 2 : 2 * mid] == b[2 * mid - 2 : 2 * mid] else (low, mid - 1)
    return low


def in_both(one: str, two: str) -> int:
    """Code points of the spans that both have, as often as both have them."""
    (a, n), (b, m) = (np.unique(np.frombuffer(base64.b64decode(x), "<u8"), return_counts=True) for x in (one, two))
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(((both & np.uint64(0xFFFFFFFF)).astype(np.int64) * np.minimum(n[i], m[j])).sum())


def likeness(one: str, two: str) -> float:
    """A lower bound of the share, 0 to 1, of the longer text that both texts have in
    common, by their fingerprints. 1 only for equal texts."""
    if one == two:
        return 1.0
    (n, _, x, p), (m, _, y, q) = one.split("."), two.split(".")
    n, m, x, y = int(n, 16), int(m, 16), base64.b64decode(x), base64.b64decode(y)
    if not n or not m:
        return 0.0
    half_x, half_y = len(x) // 2, len(y) // 2
    shared = min(half_x, half_y) // 2
    k, r = agreeing(x[:half_x], y[:half_y], shared), agreeing(x[half_x:], y[half_y:], shared)
    common = (int(RUNGS[k - 1]) if k else 0) + (int(RUNGS[r - 1]) if r else 0)
    return min(max(common, in_both(p, q)), n, m, max(n, m) - 1) / max(n, m)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fingerprint_batch([t.decode() for t in texts_of(b.column(1))]), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, extra, doc_id, text: the rows in ranges of their ids, each range followed
    by the row after its last one (extra), in order within a partition. One shuffle
    of the texts; a range's extra row is the one that opens the next range."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = IdRanges(rows, "doc_id", shuffle_parts(spark))

    def run(batches):
        opens = {int(x): k for k, x in enumerate(ranges.bounds)}
        if ranges.rows:
            opens_all = ranges.first
        for b in batches:
            part = ranges.of(b.column(0))
            names = ["part", "extra", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), np.int32)), *b.columns], names)
            ids = b.column(0).to_pylist()
            extra = [(k, i) for i, x in enumerate(ids) for k in [*([opens[x]] if x in opens else []), *([ranges.parts - 1] if x == opens_all else [])]]
            if extra:
                again = b.take(pa.array([i for _, i in extra]))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in extra], pa.int32()), pa.array(np.ones(len(extra), np.int32)), *again.columns], names)

    dealt = rows.mapInArrow(run, "part int, extra int, doc_id long, text string")
    return dealt.repartitionById(ranges.parts, "part").sortWithinPartitions("part", "extra", "doc_id", "text")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(ids, texts, following, prints, after):
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        other = fingerprint_batch(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(prints, pa.string()), pa.array(other, pa.string()), pa.array([likeness(x, y) for x, y in zip(prints, other, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(prints, after, strict=True)], pa.float64())],
            names,
        )

    def run(batches):
        held = None  # the row that waits for its next one: (part, id, text, fingerprint)
        for b in batches:
            part, extra, ids = (b.column(i).to_pylist() for i in range(3))
            texts = [t.decode() for t in texts_of(b.column(3))]
            prints = fingerprint_batch(texts)
            rows = []
            for k in range(len(ids)):
                if held and held[0] == part[k]:
                    rows.append((held[1], held[2], texts[k], held[3], prints[k]))
                # further extra rows of an id have no row before them
                held = None if extra[k] else (part[k], ids[k], texts[k], prints[k])
            if rows:
                yield results(*zip(*rows, strict=True))

    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
