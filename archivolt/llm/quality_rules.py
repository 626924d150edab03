"""Quality rules on repetition, by suffix arrays over words.

The words of many documents lie in one flat array, each document closed by an
entry of its own, and are ranked by document and word, so that no match leaves
its document. Prefix doubling sorts the suffixes; only those not yet alone in
their class are sorted again. The ranks of each doubling answer the longest
common prefix of neighbours in the array. At each word, the deeper of the two
longest-common-prefix intervals that its suffix is in gives the longest repeat
that starts there; the union of these spans is the covered part.

Rules: fewer than ``min_words`` words, or over ``base_percent`` of the words in
repeated windows of ``window`` words (base_failed); over ``max_covered`` of the
words in repeats of ``min_repeat`` words or more; a repeat of more than
``max_longest`` words. Null or empty text has no words and fails. Rows are judged
each by itself: ties, repeated rows and null ids make no difference; an empty
table gives an empty result and other columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import SPACES, bound_batches, slices, texts_of

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of a flat array; a longer document is one of its own.
FLAT = 1 << 18


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    base_percent: int = 30
    min_repeat: int = 4
    max_covered: float = 0.4
    max_longest: int = 50


def longest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each place of the flat array, the words of the longest repeat within its
    document that starts there. ``doc`` doesn't fall; ``word`` are ids from 0."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    docs = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(n) + np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    m = n + len(docs)
    key = np.full(m, -1, np.int64)
    span = int(word.max()) + 2
    key[place] = doc * span + word + 1
    ends = np.r_[place[docs[1:] - 1], place[-1]] + 1
    key[ends] = doc[np.r_[docs[1:] - 1, n - 1]] * span  # closes its document; found once
    rank, active = regroup(key, np.arange(m), np.zeros(m, np.int64))
    ranks, step = [rank], 1
    while len(active):
        nxt = rank.copy()
        at = np.minimum(active + step, m - 1)
        part, again = regroup(rank[active] * m + rank[at], active, rank[active])
        nxt[active] = part
        active, rank, step = again, nxt, 2 * step
        ranks.append(rank)
    order = np.empty(m, np.int64)
    order[rank] = np.arange(m)
    a, b, common = order[:-1], order[1:], np.zeros(m - 1, np.int64)
    for k in reversed(range(len(ranks) - 1)):  # no two suffixes share the last rank
        i, j = a + common, b + common
        ok = (i < m) & (j < m)
        same = np.zeros(m - 1, bool)
        same[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        common[same] += 1 << k
    lcp = np.r_[0, common, 0]
    deepest = np.empty(m, np.int64)
    deepest[order] = np.maximum(lcp[:-1], lcp[1:])
    return deepest[place]


def regroup(key: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the places ``at`` by ``key``, each the number of smaller entries: its
    class's rank so far, ``base``, and its place in that class. Also the places that
    share their rank. Classes must be told apart by the key, in order."""
    order = np.argsort(key, kind="stable")
    k, b = key[order], base[order]
    new = np.r_[True, k[1:] != k[:-1]]
    top = np.r_[True, b[1:] != b[:-1]]
    index = np.arange(len(k))
    first = np.maximum.accumulate(np.where(new, index, 0))
    start = np.maximum.accumulate(np.where(top, index, 0))
    rank = np.empty(len(k), np.int64)
    rank[order] = b + first - start
    alone = new & np.r_[new[1:], True]
    return rank, at[np.sort(order[~alone])]


def covered(repeat: np.ndarray, least: int, ends: np.ndarray) -> np.ndarray:
    """Which words are in a repeat of ``least`` words or more. ``ends``: no span goes
    beyond (for safety of the flat array's end)."""
    mark = np.zeros(len(repeat) + 1, np.int64)
    at = np.flatnonzero(repeat >= least)
    mark[at] += 1
    np.subtract.at(mark, np.minimum(at + repeat[at], ends[at]), 1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[bytes], rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The figures and verdicts of each text."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    out = {"n_words": n, "word_chars": np.array([len(t.translate(None, SPACES).decode()) for t in texts], np.int64), "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)}
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    out |= {k: np.zeros(len(texts), np.int64) for k in ("n_repeat_words", "n_covered", "longest_repeat", "n_repeats")}
    for a, b in slices(n.tolist(), FLAT):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        total = int(n[a:b].sum())
        if not total:
            continue
        word = np.fromiter((ids[w] for ws in split[a:b] for w in ws), np.int64, total)
        doc = np.repeat(np.arange(b - a), n[a:b])
        repeat = longest_repeats(doc, word)
        ends = np.repeat(np.cumsum(n[a:b]), n[a:b])
        have = np.flatnonzero(n[a:b])
        starts = (np.cumsum(n[a:b]) - n[a:b])[have]
        before = np.r_[0, np.where(doc[1:] == doc[:-1], repeat[:-1], 0)]
        for name, flags in (("n_repeat_words", covered(repeat, rules.window, ends)), ("n_covered", covered(repeat, rules.min_repeat, ends)), ("n_repeats", (repeat >= rules.min_repeat) & (before <= repeat))):
            out[name][a + have] = np.add.reduceat(flags.astype(np.int64), starts)
        out["longest_repeat"][a + have] = np.maximum.reduceat(repeat, starts)
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.base_percent * n)
    out["kept"] = ~out["base_failed"] & (out["n_covered"] <= rules.max_covered * n) & (out["longest_repeat"] <= rules.max_longest)
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, n_repeats long, base_failed boolean, kept boolean"


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """doc_id and the figures and verdicts of each row."""
    bound_batches(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches):
        for b in batches:
            found = measure(texts_of(b.column(1)), rules)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(found[c]) for c in names)], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def passing(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that all rules keep, with all their columns. Only texts go to Python."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(measure(texts_of(texts), rules)["kept"])

    return docs.where(good(F.col(text_col).cast("string")))
