"""Ranked lexical search by Block-Max WAND.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII,
with A-Z lower-cased. ``statistics`` counts documents and terms; ``index`` makes shards of
consecutive documents of about ``SHARD_BYTES`` of text. In a shard the documents are
numbered by ascending id; a term's postings, pairs of number and frequency, lie in blocks
of ``BLOCK`` as variable-length bytes of gaps and frequencies, and beside each block are
its first and last document and its maximum impact. A row holds one term of one shard,
and a row of its own the shard's document ids and lengths. The index can be written and
searched again.

``search`` takes as queries all given rows, in blocks of about ``AT_ONCE``; with a block's
rows go its queries' weights, so nothing is broadcast by hand. In each shard and block of
queries the lists' shallow pointers move over the borders of their blocks, in order of the
documents, ``STRIDE`` stretches between borders at a time. A stretch in which the maximum
impacts of the blocks under all pointers can't reach the threshold is skipped; a block
that lies in such stretches only is never decompressed. The documents of the others are
scored. The threshold is the tenth best score of the shard so far, and from the start the
best of the terms' tenth highest block maxima over all shards: ten documents reach that by
this one term. It never excludes an equal score. Shards yield ten rows a query at most; a
window with a limit merges them.

The weight of a term is floor(1000 ln((2N + 2) / (2 df + 1))); a document scores the sum of
weight times (10^9 tf) div (1000 tf + 8 m) over the query's terms, repeats included, with
m = 25 + (75 n N) div L. N is the number of documents with a term, L that of all terms, n
the document's. Scores are exact integers.

Null and empty texts have no terms. Repeated rows are documents of their own, with equal
scores; so are rows of one id. Null ids come after all others. Equal queries (id and text)
count once; queries of one id and different texts are each ranked. A query without a
term that any document holds has no row; an empty table gives an empty result. Very long
texts make a shard of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, materialise, texts_of

BLOCK = 128
SHARD_BYTES = 16 << 20
AT_ONCE = 256
#: Stretches between borders that all pointers pass at a time.
STRIDE = 256
#: Upper and lower case, and the pattern of terms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same, byte by byte: all bytes beyond ASCII belong to characters beyond ASCII.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term binary, is_docs boolean, df long, first array<int>, last array<int>, most array<int>, ends array<int>, data binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L: the documents with a term, and all their terms."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for text in texts_of(b.column(0)):
                k = len(terms_of(text))
                n += k > 0
                total += k
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


# --- compression

def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values as bytes, seven bits each, the lowest first, the top bit set where more
    follow; and where each value ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - size
    for k in range(5):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        out[begins[at] + k] = (values[at] >> 7 * k & 127) | (size[at] > k + 1).astype(np.int64) << 7
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(raw < 128)
    if len(stops) == len(raw):
        return raw.astype(np.int64)
    begins = np.r_[0, stops[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.r_[begins, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begins)


# --- the index

class Shard:
    """Documents of one shard while they are read."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0
        self.names: defaultdict[bytes, int] = defaultdict()
        self.names.default_factory = self.names.__len__

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        self.size += len(text)
        if words:
            found = Counter(words)
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.terms.append(np.fromiter(map(self.names.__getitem__, found), np.int32, len(found)))
            self.times.append(np.fromiter(found.values(), np.int32, len(found)))

    def rows(self, number: int, n: int, total: int, slice_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """The index rows; n and total are those of all documents."""
        if not self.ids:
            return
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        counts = np.array([len(t) for t in self.terms])
        doc, term, tf = np.repeat(place, counts), np.concatenate(self.terms), np.concatenate(self.times).astype(np.int64)
        self.terms, self.times = [], []
        by = np.argsort(term.astype(np.int64) * len(order) + doc)
        doc, term, tf = doc[by], term[by], tf[by]
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * shortness(lengths[order], n, total)[doc])
        df = np.bincount(term, minlength=len(self.names))
        begins = np.cumsum(df) - df
        starts = np.flatnonzero((np.arange(len(term)) - begins[term]) % BLOCK == 0)
        stops = np.r_[starts[1:], len(term)]
        gap = np.diff(doc, prepend=0)
        gap[starts] = doc[starts]
        data, ends = packed(np.stack([gap, tf], 1).ravel())
        block_ends = ends[2 * stops - 1]
        blocks = -(-df // BLOCK)  # of each term
        block_at = np.r_[0, np.cumsum(blocks)].astype(np.int32)
        data_at = np.r_[0, block_ends[block_at[1:] - 1]].astype(np.int64)
        relative = (block_ends - np.repeat(data_at[:-1], blocks)).astype(np.int32)
        per_block = [x.astype(np.int32) for x in (doc[starts], doc[stops - 1], np.maximum.reduceat(impact, starts), relative)]
        names = list(self.names)
        columns = [f.split()[0] for f in INDEX.split(", ")]
        for a in range(0, len(names), slice_rows):
            z = min(a + slice_rows, len(names))
            low, high = block_at[a], block_at[z]
            lists = [pa.ListArray.from_arrays(pa.array(block_at[a : z + 1] - low), pa.array(x[low:high])) for x in per_block]
            raw = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((data_at[a : z + 1] - data_at[a]).astype(np.int32)), pa.py_buffer(data[data_at[a] : data_at[z]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, number)), pa.array(names[a:z], pa.binary()), pa.array(np.zeros(z - a, bool)), pa.array(df[a:z]), *lists, raw], columns)
        held = ids[order].astype("<i8").tobytes() + lengths[order].astype("<i8").tobytes() + known[order].astype(np.uint8).tobytes()
        none = pa.array([[]], pa.list_(pa.int32()))
        # no term holds a zero byte
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"\0" + number.to_bytes(8, "big")], pa.binary()), pa.array([True]), pa.array([len(ids)]), none, none, none, none, pa.array([held], pa.binary())], columns)


def shortness(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms."""
    return 25 + 75 * lengths * n // max(1, total)


def index(docs: DataFrame, counted: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of all shards; ``counted`` is what ``statistics`` found."""
    bound_batches(docs.sparkSession)
    n, total = counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                if shard.size and shard.size + len(text) > SHARD_BYTES:
                    yield from shard.rows(number, n, total)
                    number, shard = number + 1, Shard()
                shard.add(doc_id, text)
        yield from shard.rows(number, n, total)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX)


# --- the search

class Lists:
    """The posting lists of one shard, by term number; blocks that were decompressed are
    kept for the queries to come."""

    def __init__(self, docs: bytes, size: int, n: int, total: int):
        self.ids = np.frombuffer(docs, "<i8", size)
        self.m = shortness(np.frombuffer(docs, "<i8", size, 8 * size).astype(np.int64), n, total)
        self.known = np.frombuffer(docs, np.uint8, size, 16 * size)
        self.first: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.data: list[bytes] = []
        self.deep: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, first: list[int], last: list[int], most: list[int], ends: list[int], data: bytes) -> int:
        for held, x in ((self.first, first), (self.last, last), (self.most, most), (self.ends, ends)):
            held.append(np.asarray(x, np.int64))
        self.data.append(data)
        return len(self.data) - 1

    def block(self, t: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of one block."""
        if (t, b) not in self.deep:
            begin = int(self.ends[t][b - 1]) if b else 0
            pairs = unpacked(np.frombuffer(self.data[t], np.uint8, int(self.ends[t][b]) - begin, begin)).reshape(-1, 2)
            doc, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            self.deep[t, b] = doc, 1_000_000_000 * tf // (1000 * tf + 8 * self.m[doc])
        return self.deep[t, b]

    def best(self, weights: list[tuple[int, int]], need: int, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best documents of at least ``need``, of equals the
        first; ``weights`` are those of the query's terms by number."""
        terms, weight = [t for t, _ in weights], np.array([w for _, w in weights], np.int64)
        if not terms:
            return []
        size = [len(self.last[t]) for t in terms]
        owner = np.repeat(np.arange(len(terms)), size)
        number = np.concatenate([np.arange(n) for n in size])
        first, stop = np.concatenate([self.first[t] for t in terms]), np.concatenate([self.last[t] for t in terms]) + 1
        reach = weight[owner] * np.concatenate([self.most[t] for t in terms])
        # between two borders no list's shallow pointer moves to another block
        borders = np.unique(np.concatenate([first, stop]))
        begin, end = np.searchsorted(borders, first), np.searchsorted(borders, stop)
        bound = np.zeros(len(borders), np.int64)
        np.add.at(bound, begin, reach)
        np.subtract.at(bound, end, reach)
        bound = np.cumsum(bound)
        scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        for s in range(0, len(borders) - 1, STRIDE):
            e = min(s + STRIDE, len(borders) - 1)
            alive = bound[s:e] >= need
            if not alive.any():
                continue
            low, high = int(borders[s]), int(borders[e])
            before = np.r_[0, np.cumsum(alive)]
            wanted = before[np.clip(end, s, e) - s] > before[np.clip(begin, s, e) - s]
            sums = np.zeros(high - low, np.int64)
            for j in np.flatnonzero(wanted).tolist():
                t = owner[j]
                doc, impact = self.block(terms[t], int(number[j]))
                if first[j] < low or stop[j] > high:
                    a, z = doc.searchsorted((low, high))
                    doc, impact = doc[a:z], impact[a:z]
                sums[doc - low] += weight[t] * impact
            # the sums of stretches that were skipped aren't whole
            at = np.flatnonzero((sums >= need) & np.repeat(alive, np.diff(borders[s : e + 1])))
            scores, docs = np.concatenate([scores, sums[at]]), np.concatenate([docs, at + low])
            if len(scores) >= k:
                top = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[top], docs[top]
                need = max(need, int(scores[-1]) + 1)  # those to come have larger ids
        return list(zip(scores.tolist(), docs.tolist(), strict=True))


def asked(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, id_col, block, term and times of each query's terms; written once, as keys are
    given by place."""
    each = queries.select(F.col(id_col), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("_t")).distinct()
    keyed = each.withColumn("key", F.monotonically_increasing_id())
    words = keyed.select("key", id_col, F.explode(F.regexp_extract_all("_t", F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    counted = words.groupBy("key", id_col, F.encode("term", "UTF-8").alias("term")).agg(F.count(F.lit(1)).alias("times"))
    return materialise(counted, "queries")[0]


def search(found: DataFrame, counted: tuple[int, int], queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each query's k best documents of a score above 0;
    ``found`` are index rows."""
    spark = queries.sparkSession
    n, total = counted
    query = asked(queries, id_col, text_col)
    blocks = -(-query.agg(F.count_distinct("key")).first()[0] // AT_ONCE) or 1
    query = query.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    wanted = query.select("term").distinct().withColumn("_wanted", F.lit(True))
    hits, _ = materialise(found.join(wanted, "term", "left").where("is_docs or _wanted").drop("_wanted"), "postings")
    postings = hits.where("not is_docs")
    # weights, and what ten documents reach by one term
    df = postings.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    best = postings.select("term", F.explode("most").alias("most")).withColumn("_k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("most")))).where(F.col("_k") <= k)
    reached = best.groupBy("term").agg(F.min("most").alias("most"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("term", F.col("most").cast("long").alias("kth"))
    weighed = query.join(df, "term").join(reached, "term", "left").select("key", "block", "term", (weight * F.col("times")).alias("weight"), F.coalesce("kth", F.lit(0)).alias("kth")).where("weight > 0")
    floors = weighed.groupBy("key").agg(F.greatest(F.max(F.col("weight") * F.col("kth")), F.lit(1)).alias("need"))
    sent = weighed.join(floors, "key").groupBy("block", "term").agg(F.collect_list(F.struct("key", "weight", "need")).alias("asked"))  # of a block of queries
    both = postings.join(sent, "term")
    docs = hits.where("is_docs").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(None).cast(sent.schema["asked"].dataType))
    columns = ["shard", "block", "is_docs", "df", "first", "last", "most", "ends", "data", "asked"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(columns[2:]).to_pylist()
        head = next(r for r in rows if r["is_docs"])
        lists = Lists(head["data"], head["df"], n, total)
        every: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        for r in rows:
            if not r["is_docs"]:
                t = lists.add(r["first"], r["last"], r["most"], r["ends"], r["data"])
                for q in r["asked"]:
                    every.setdefault(q["key"], (q["need"], []))[1].append((t, q["weight"]))
        out = [(key, score, doc) for key, (need, weights) in every.items() for score, doc in lists.best(weights, need, k)]
        keys, scores, at = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"key": keys, "doc_id": pa.array(lists.ids[at], pa.int64(), mask=lists.known[at] == 0), "score": scores})

    each = both.select(*columns).unionByName(docs.select(*columns)).groupBy("shard", "block").applyInArrow(run, "key long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(query.select("key", id_col).distinct(), "key").select(F.col(id_col).alias("item_id"), "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``search`` of all documents, by an index made for it."""
    counted = statistics(docs)
    return search(index(docs, counted), counted, queries, k)
