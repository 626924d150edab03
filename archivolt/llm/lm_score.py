"""Masked pseudo-likelihood of documents under a bidirectional window network.

A word (split at [\\x20\\x09-\\x0D]) is predicted from the two words before and the two
words behind it, never from itself. All of the following is gathered from the whole
corpus, and grows with it:

- the counts of all words, by 64-bit hash, in a distributed table. The vocabulary is
  the most frequent ``words_factor`` sqrt(N) of N running words; every other word is
  rare. Rare words are one class of their own, whose mass is that of all their
  occurrences, and within it a word's probability is that of its spelling, by pairs
  of bytes counted over all rare occurrences.
- the most frequent ``TOP`` words' counts beside each other, by which k-means puts them
  into ``COMPANY`` groups; then for each word of the vocabulary how many of its neighbours
  are of each group. By these shares k-means makes sqrt(V) / 4 classes of words in like
  company.
- the network: embeddings of vocabulary words (one each, one for rare words, one for
  beyond the text's ends), a hidden layer, a softmax over groups of about the square root
  of the classes, and one over the classes of the word's group, so a word's cost grows
  with that root. Rare words are a group of their own. Within a class a word has its
  share of the counts.
- how often each span of words occurs. Spans end behind words whose hash is divisible by
  ``SPAN``, so equal passages have equal spans. A span that c other places have is
  recalled from them with probability c / (c + 1), c taken as 1, 2, 4 or 16; a word's
  probability is that share of 1, and the rest of the network's.

A document's score is the sum of the log-probabilities of its words;
``network_log_likelihood`` is that sum without recall, each term a distribution over all
words given the words around.

Training is by gradient steps in numpy, in each task over all its documents, in two
rounds: an eighth of the documents from a common start, then the others from the average of
what the tasks made of the first. Averages are taken in groups of ``FAN`` tasks, then of
such groups, so no task or driver holds more than that many models. So scores
depend but little on how the table is split (README has the measure).

Null text is the empty text: no words, sum 0, mean null. Repeated rows count as often
as they occur and get the same score. Null ids are kept. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, materialise, remove, slices, texts_of
from archivolt.llm.strings import hashes

OFFSETS = (-2, -1, 1, 2)
#: Bytes of text in a flat array; a longer text has one of its own.
FLAT = 1 << 21
#: Mean words of a span.
SPAN = 16
#: Other places of a span that are told apart, from the largest on.
OTHERS = (16, 4, 2, 1)
#: Models that are averaged at once.
FAN = 16
#: Words that are put into groups, and the groups.
TOP, COMPANY = 256, 12
#: Different words a task holds while it counts.
HELD = 1 << 20
START, BYTES = 256, 257


@dataclass(frozen=True)
class Shape:
    words_factor: float = 16.0
    embedding: int = 8
    hidden: int = 24
    batch: int = 2048
    rate: float = 0.05


class Words:
    """The words of some texts: hash of each, a second one if ``both``, its bytes' place,
    words of each text."""

    def __init__(self, texts: list[bytes], both: bool = True):
        self.flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        white = np.r_[True, (self.flat == 32) | (self.flat - np.uint8(9) < 5), True]
        edges = np.flatnonzero(white[1:] != white[:-1])
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        self.hash, self.second = hashes(self.flat, self.starts, self.ends, both)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.at = np.searchsorted(self.starts, bounds)
        self.n = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(texts)), self.n)


def flats(texts: list[bytes], both: bool = False) -> Iterator[tuple[int, int, Words]]:
    for i, j in slices([len(t) for t in texts], FLAT):
        yield i, j, Words(texts[i:j], both)


def word_counts(rows: DataFrame) -> DataFrame:
    """word (hash), n of all words of the corpus."""

    def run(batches):
        word, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for b in batches:
            for _, _, w in flats(texts_of(b.column(1))):
                new, count = np.unique(w.hash, return_counts=True)
                both, of = np.unique(np.concatenate([word, new]), return_inverse=True)
                word, n = both, np.bincount(of, np.concatenate([n, count]), minlength=len(both)).astype(np.int64)
                if len(word) > HELD:
                    yield out()
                    word, n = word[:0], n[:0]
        if len(word):
            yield out()

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """words: hashes, sorted; count of each, total of all words' counts; classes (the last
    one is that of rare words); share: logarithm of each word's share of its class;
    spelling: log-probabilities of pairs of bytes, BYTES a row."""

    words: np.ndarray
    count: np.ndarray
    total: int
    of: np.ndarray | None = None
    classes: int = 1
    share: np.ndarray | None = None
    spelling: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.words)

    @property
    def bounds(self) -> np.ndarray:
        """Where the groups of classes begin, and the end."""
        most = self.classes - 1
        return np.r_[np.arange(0, most, max(1, round(most**0.5))), most, most + 1]

    def index(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each word; ``size`` for rare ones."""
        if not self.size:
            return np.zeros(len(hashed), np.int64)
        order = np.argsort(hashed)  # what is sought in order is found in the cache
        wanted = hashed[order]
        at = np.minimum(np.searchsorted(self.words, wanted), self.size - 1)
        out = np.empty(len(hashed), np.int64)
        out[order] = np.where(self.words[at] == wanted, at, self.size)
        return out


def byte_pairs(w: Words, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all pairs of bytes of the words at the places ``rare``, from the start to
    the end of each (white space stands for the end), and how many each word has."""
    size = (w.ends - w.starts)[rare] + 1
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(w.starts[rare], size)
    following = w.flat[at].astype(np.int64)
    following[first + size - 1] = START
    before = np.r_[0, following[:-1]][: len(following)]
    before[first] = START
    return before * BYTES + following, size


def contexts(index: np.ndarray, n: np.ndarray, edge: int) -> np.ndarray:
    """The words around each word; beyond its document's ends, ``edge``."""
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full((len(index), len(OFFSETS)), edge, np.int64)
    for k, o in enumerate(OFFSETS):
        here, there = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        if len(index) > abs(o):
            out[here, k] = np.where(doc[here] == doc[there], index[there], edge)
    return out


def beside(rows: DataFrame, top: np.ndarray) -> np.ndarray:
    """How often each of the ``top`` words (hashes, sorted) has each of them around."""
    size = len(top)

    def run(batches):
        v, total = Vocabulary(top, np.empty(0), 0), np.zeros((size + 1) ** 2, np.int64)
        for b in batches:
            for _, _, w in flats(texts_of(b.column(1))):
                index = v.index(w.hash)
                here = np.flatnonzero(index < size)
                near = contexts(index, w.n, size)[here]
                total += np.bincount((index[here, None] * (size + 1) + near).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    got = rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1) ** 2)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size + 1, size + 1)[:size, :size]


def grouped(v: Vocabulary, rows: DataFrame) -> np.ndarray:
    """The group of each word of the vocabulary; ``COMPANY`` if it has none."""
    group = np.full(v.size + 2, COMPANY)
    if v.size:
        top = np.sort(np.argsort(-v.count, kind="stable")[:TOP])
        table = beside(rows, v.words[top])
        # shares as square roots: their distances are those of distributions
        x = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
        group[top] = clusters(x, v.count[top], min(COMPANY, len(top)))
    return group


def company(rows: DataFrame, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of the vocabulary how many neighbours are of each group; counts of
    pairs of bytes of rare words."""
    known = rows.sparkSession.sparkContext.broadcast((v, grouped(v, rows)))

    def run(batches):
        v, group = known.value
        total, pairs = np.zeros((v.size + 1) * (COMPANY + 1), np.int32), np.zeros(BYTES * BYTES, np.int64)
        for b in batches:
            for _, _, w in flats(texts_of(b.column(1))):
                index = v.index(w.hash)
                near = group[contexts(index, w.n, v.size + 1)]
                np.add.at(total, (index[:, None] * (COMPANY + 1) + near).ravel(), np.int32(1))
                pairs += np.bincount(byte_pairs(w, np.flatnonzero(index == v.size))[0], minlength=len(pairs))
        table = total.reshape(v.size + 1, COMPANY + 1)[:-1, :COMPANY]
        at = np.flatnonzero(table.any(axis=1))
        names = ["k", *(f"c{i}" for i in range(COMPANY))]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(table[at, i].astype(np.int64)) for i in range(COMPANY))], names)
        # pairs of bytes follow, with places below zero
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.array(pairs[at]), *(pa.array(np.zeros(len(at), np.int64)) for _ in range(COMPANY - 1))], names)

    sums = ", ".join(f"c{i} long" for i in range(COMPANY))
    got = rows.mapInArrow(run, f"k long, {sums}").groupBy("k").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(COMPANY))).toArrow()
    k = got["k"].to_numpy()
    values = np.column_stack([got[f"c{i}"].to_numpy() for i in range(COMPANY)]) if len(k) else np.zeros((0, COMPANY))
    table, pairs = np.zeros((v.size, COMPANY)), np.zeros(BYTES * BYTES)
    table[k[k >= 0]] = values[k >= 0]
    pairs[-1 - k[k < 0]] = values[k < 0, 0]
    return table, pairs


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from centres that lie far apart, the heaviest row first."""
    if k < 2 or len(x) < 2:
        return np.zeros(len(x), np.int64)
    # frequent words have the surest vectors: the centres are sought among them
    some = np.argsort(-weight, kind="stable")[: max(64 * k, 1024)]
    centre = [x[some[0]]]
    far = ((x[some] - centre[0]) ** 2).sum(axis=1)
    for _ in range(min(k, len(some)) - 1):
        centre.append(x[some[int(np.argmax(far * np.sqrt(weight[some])))]])
        far = np.minimum(far, ((x[some] - centre[-1]) ** 2).sum(axis=1))
    c = np.array(centre)
    of = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        for i in range(0, len(x), 1 << 14):
            part = x[i : i + (1 << 14)]
            of[i : i + (1 << 14)] = ((c * c).sum(axis=1) - 2 * part @ c.T).argmin(axis=1)
        mass = np.bincount(of, weight, minlength=len(c))
        for d in range(x.shape[1]):
            c[:, d] = np.where(mass > 0, np.bincount(of, weight * x[:, d], minlength=len(c)) / np.maximum(mass, 1e-12), c[:, d])
    return of


def vocabulary(rows: DataFrame, shape: Shape) -> Vocabulary:
    counted, path = materialise(word_counts(rows), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    size = max(16, int(shape.words_factor * total**0.5))
    top = counted.orderBy(F.desc("n"), "word").limit(size).toArrow()  # sqrt(N) rows
    remove(rows.sparkSession, path)
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(words)
    v = Vocabulary(words[order], n[order].astype(float), int(total))
    table, pairs = company(rows, v)
    table += 4 * table.sum(axis=0) / max(table.sum(), 1)  # few neighbours tell less
    x = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1e-9))
    v.classes = max(2, int(v.size**0.5 / 4)) + 1
    of = clusters(x, v.count, v.classes - 1)
    # classes of like company stand beside each other, so in a group
    weight = np.bincount(of, v.count, minlength=v.classes - 1)
    centre = np.column_stack([np.bincount(of, v.count * x[:, d], minlength=v.classes - 1) for d in range(x.shape[1])])
    place = np.empty(v.classes - 1, np.int64)
    place[np.lexsort((-weight, centre.argmax(axis=1)))] = np.arange(v.classes - 1)
    v.of = np.append(place[of], v.classes - 1)
    mass = np.bincount(v.of[:-1], v.count, minlength=v.classes)
    v.share = np.append(np.log(v.count / mass[v.of[:-1]]), 0.0)
    table = pairs.reshape(BYTES, BYTES) + 0.5
    v.spelling = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
    return v


def sizes(v: Vocabulary, shape: Shape) -> dict[str, tuple[int, ...]]:
    wide = len(OFFSETS) * shape.embedding
    groups = len(v.bounds) - 1
    return {"e": (v.size + 2, shape.embedding), "w": (wide, shape.hidden), "b": (shape.hidden,), "u": (shape.hidden, groups), "c": (groups,), "v": (shape.hidden, v.classes), "d": (v.classes,)}


def split(flat: np.ndarray, v: Vocabulary, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in sizes(v, shape).items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def start(v: Vocabulary, shape: Shape, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.standard_normal(s) * (0.0 if len(s) == 1 else 0.3 if k == "e" else 1 / np.sqrt(s[0]))).astype(np.float32).ravel() for k, s in sizes(v, shape).items()])
    mass = np.bincount(v.of[:-1], v.count, minlength=v.classes)
    mass[-1] = max(v.total - v.count.sum(), 0)
    p = split(flat, v, shape)
    p["d"][:] = np.log((mass + 0.5) / (mass + 0.5).sum())
    p["c"][:] = np.log(np.add.reduceat(mass + 0.5, v.bounds[:-1]) / (mass + 0.5).sum())
    return flat


def forward(p: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.take(p["e"], context.ravel(), axis=0).reshape(len(context), -1)
    return x, np.tanh(x @ p["w"] + p["b"])


def shares(z: np.ndarray) -> np.ndarray:
    """The softmax of each column, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each column at its row ``at``; ``z`` is overwritten."""
    z -= z.max(axis=0)
    one = z[at, np.arange(len(at))]
    return one - np.log(np.exp(z, out=z).sum(axis=0))


def by_group(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of the groups, the group of each target, the targets' order by group, and
    where each group begins in it."""
    bounds = v.bounds
    most = np.min_scalar_type(len(bounds))  # small numbers are sorted by radix
    group = np.repeat(np.arange(len(bounds) - 1, dtype=most), np.diff(bounds))[target]
    begins = np.r_[0, np.cumsum(np.bincount(group, minlength=len(bounds) - 1))]
    return bounds, group.astype(np.int64), np.argsort(group, kind="stable"), begins


def blocks(bounds: np.ndarray, begins: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """The classes of each group and the rows, ordered by group, that are of it."""
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if i < j:
            yield slice(a, b), slice(i, j)


def with_one(h: np.ndarray) -> np.ndarray:
    """The rows with a 1 behind each, which the biases are multiplied by."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def in_group(weights: np.ndarray, bounds: np.ndarray, begins: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scores of the classes of each row's group, in a column; minus infinity in place of
    classes that its group lacks. ``h`` is ordered by group, ``weights`` has a row a class."""
    out = np.full((int(np.diff(bounds).max()), len(h)), -np.inf, np.result_type(h, weights))
    for classes, rows in blocks(bounds, begins):
        out[: classes.stop - classes.start, rows] = weights[classes] @ h[rows].T
    return out


def class_logs(p: dict[str, np.ndarray], v: Vocabulary, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each target class."""
    bounds, group, order, begins = by_group(v, target)
    h, target, group = with_one(np.take(h, order, axis=0)), target[order], group[order]
    log = log_share(np.vstack([p["u"], p["c"]]).T @ h.T, group)
    log += log_share(in_group(np.vstack([p["v"], p["d"]]).T, bounds, begins, h), target - bounds[group])
    out = np.empty_like(log)
    out[order] = log
    return out


def put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Rows of a table set, each as one value."""
    whole = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(whole)[:, 0][at] = rows.view(whole)[:, 0]


def sums_by_word(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words, and of each the sum of its columns of ``values`` (dimensions,
    places of words) as a row."""
    order = np.argsort(words)
    sorted_words = words[order]
    new = np.r_[True, sorted_words[1:] != sorted_words[:-1]]
    of = np.empty(len(words), np.int64)
    of[order] = np.cumsum(new) - 1
    rows = sorted_words[new]
    out = np.empty((len(rows), len(values)), values.dtype)
    for d, x in enumerate(values):
        out[:, d] = np.bincount(of, x, len(rows))
    return rows.astype(np.int64), out


def step(p: dict[str, np.ndarray], v: Vocabulary, squares: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of Adagrad on the cross-entropy of a batch, in place; of the embeddings
    only the batch's own rows are touched."""
    n = len(target)
    bounds, group, order, begins = by_group(v, target)
    context, target, group, each = np.take(context, order, axis=0), target[order], group[order], np.arange(n)
    x, h = forward(p, context)
    h1, upper, lower = with_one(h), np.vstack([p["u"], p["c"]]), np.ascontiguousarray(np.vstack([p["v"], p["d"]]).T)
    g = shares(upper.T @ h1.T)
    g[group, each] -= 1
    g /= n
    q = shares(in_group(lower, bounds, begins, h1))
    q[target - bounds[group], each] -= 1
    q /= n
    into_hidden, deeper = g.T @ p["u"].T, np.zeros_like(lower)
    for classes, rows in blocks(bounds, begins):
        some = q[: classes.stop - classes.start, rows]
        into_hidden[rows] += some.T @ lower[classes, :-1]
        deeper[classes] = some @ h1[rows]
    back = into_hidden * (1 - h * h)
    into = (p["w"] @ back.T).reshape(len(OFFSETS), -1, n).transpose(1, 0, 2).reshape(-1, n * len(OFFSETS))
    rows, deep = sums_by_word(context.T.ravel().astype(np.int32), into)
    square = np.take(squares["e"], rows, axis=0)
    square += deep * deep
    put(squares["e"], rows, square)
    put(p["e"], rows, np.take(p["e"], rows, axis=0) - rate * deep / np.sqrt(square + 1e-8))
    higher = (g @ h1).T
    for k, grad in (("w", x.T @ back), ("b", back.sum(axis=0)), ("u", higher[:-1]), ("c", higher[-1]), ("v", deeper.T[:-1]), ("d", deeper.T[-1])):
        squares[k] += grad * grad
        p[k] -= rate * grad / np.sqrt(squares[k] + 1e-8)


def averaged(models: DataFrame) -> bytes | None:
    """The mean of flat models, weighted by ``n``, ``FAN`` at a time."""
    schema = "part long, n double, flat binary"

    def mean(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        total = np.zeros(len(group["flat"][0].as_buffer()) // 4)
        for k, w in enumerate(n.tolist()):
            total += w * np.frombuffer(group["flat"][k].as_buffer(), np.float32)
        return pa.table({"part": [group["part"][0].as_py()], "n": [float(n.sum())], "flat": [(total / n.sum()).astype(np.float32).tobytes()]})

    now, path = materialise(models, "models")
    level, paths = 1, [path]
    while now.count() > 1:
        level *= FAN
        now, path = materialise(now.groupBy(F.floor(F.col("part") / level).alias("g")).applyInArrow(mean, schema), "models")
        paths.append(path)
    one = now.first()
    for path in paths:
        remove(models.sparkSession, path)
    return None if one is None else bytes(one["flat"])


def trained(rows: DataFrame, v: Vocabulary, shape: Shape, begin: np.ndarray) -> np.ndarray:
    """The parameters, averaged over tasks that each saw their documents once from
    ``begin``."""
    known = rows.sparkSession.sparkContext.broadcast((v, begin))

    def run(batches):
        v, begin = known.value
        flat = begin.copy()
        p = split(flat, v, shape)
        squares, seen = {k: np.zeros_like(x) for k, x in p.items()}, 0
        for b in batches:
            for _, _, w in flats(texts_of(b.column(1))):
                index = v.index(w.hash)
                context, target = contexts(index, w.n, v.size + 1), v.of[index]
                order = np.random.default_rng(len(index)).permutation(len(index))
                size = max(shape.batch // 8, min(shape.batch, len(index) // 64))  # a small task takes steps enough, too
                for k in range(0, len(index), size):
                    at = order[k : k + size]
                    step(p, v, squares, np.take(context, at, axis=0), target[at], shape.rate)
                seen += len(index)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "flat"])

    got = averaged(rows.mapInArrow(run, "part long, n double, flat binary"))
    return begin if got is None else np.frombuffer(got, np.float32).copy()


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray
    shape: Shape

    def log_probabilities(self, w: Words) -> np.ndarray:
        """Of each word, by the network."""
        v, p = self.vocabulary, split(self.flat, self.vocabulary, self.shape)
        index = v.index(w.hash)
        context, log = contexts(index, w.n, v.size + 1), v.share[index].astype(float)
        rare = np.flatnonzero(index == v.size)
        if len(rare):
            pairs, size = byte_pairs(w, rare)
            log[rare] = np.add.reduceat(v.spelling[pairs], np.cumsum(size) - size)
        for k in range(0, len(index), 1 << 14):
            at = slice(k, k + (1 << 14))
            log[at] += class_logs(p, v, forward(p, context[at])[1], v.of[index[at]])
        return log


def fitted(rows: DataFrame, shape: Shape = Shape()) -> Model:
    """The model of a corpus (doc_id, text)."""
    v = vocabulary(rows, shape)
    eighth = F.pmod(F.xxhash64("text"), F.lit(8)) == 0
    first = trained(rows.where(eighth), v, shape, start(v, shape))
    return Model(v, trained(rows.where(~eighth), v, shape, first), shape)


def recalled(p: np.ndarray, others: int) -> np.ndarray:
    """Log-probabilities, from the network's ``p``, where ``others`` other places have the
    span."""
    return np.log((p + others) / (others + 1))


def spans(w: Words) -> np.ndarray:
    """Where the spans of words begin."""
    if not len(w.hash):
        return np.empty(0, np.int64)
    after = np.r_[True, (w.second[:-1] % np.uint64(SPAN) == 0) | (w.doc[1:] != w.doc[:-1])]
    return np.flatnonzero(after)


def by_network(rows: DataFrame, model: Model) -> DataFrame:
    """row (a number), doc_id, n_words, log (the sum by the network) of each document, and
    row, span (hash) and gains (of the sum, where as many others as in ``OTHERS`` have it)
    of each of its spans."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    gains = [f"g{k}" for k in OTHERS]
    names = ["row", "doc_id", "n_words", "log", "span", *gains]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, w in flats(texts_of(b.column(1)), both=True):
                log = known.value.log_probabilities(w)
                number = np.arange(row, row + j - i)
                row += j - i
                total = np.bincount(w.doc, log, minlength=j - i)
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(number), b.column(0).slice(i, j - i), pa.array(w.n), pa.array(total), none, *(pa.nulls(j - i, pa.float32()) for _ in gains)], names)
                at = spans(w)
                if len(at):
                    ends = np.r_[at[1:], len(log)]
                    one, _ = hashes(w.hash & np.uint64((1 << 21) - 1) ^ w.hash >> np.uint64(43), at, ends)
                    two, _ = hashes(w.hash >> np.uint64(21) & np.uint64((1 << 21) - 1), at, ends)
                    p, sums = np.exp(log), np.add.reduceat(log, at)
                    more = [(np.add.reduceat(recalled(p, k), at) - sums).astype(np.float32) for k in OTHERS]
                    null = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number[w.doc[at]]), null, null, pa.nulls(len(at), pa.float64()), pa.array((one ^ two * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)), *(pa.array(g) for g in more)], names)

    return rows.mapInArrow(run, "row long, doc_id long, n_words long, log double, span long, " + ", ".join(f"{g} float" for g in gains))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), model: Model | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood and network_log_likelihood of
    each row, by the model of ``docs`` themselves if none is given."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got, _ = materialise(by_network(rows, model or fitted(rows, shape)), "likelihoods")
    spans = got.where("span is not null")
    # written, so that the join deals out both sides anew and large keys can be split
    often, _ = materialise(spans.groupBy("span").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0"), "spans")
    gain = F.coalesce(*(F.when(F.col("others") >= k, F.col(f"g{k}")) for k in OTHERS)).cast("double")
    gained = spans.join(often.hint("merge"), "span").groupBy("row").agg(F.sum(gain).alias("gain"))
    whole = got.where("n_words is not null").select("row", "doc_id", "n_words", "log").join(gained.hint("merge"), "row", "left")
    total = F.col("log") + F.coalesce("gain", F.lit(0.0))
    return whole.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"), F.col("log").alias("network_log_likelihood"))
