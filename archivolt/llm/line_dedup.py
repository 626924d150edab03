"""Removal of lines that many documents share, by range-partitioned line hashes.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased;
keys of fewer than ``min_chars`` code points never count. The 128-bit hashes of the
keys are dealt out by ranges of (hash, document), so that a very frequent line is
spread over many tasks, and sorted within a partition by hash, document and
position. A task streams over the runs of equal hashes. A run inside the partition
is decided there; the runs at both ends may go on in the neighbours, so their
document counts (two rows a partition) are added up and given back.

mode "all": keys found in ``min_docs`` documents or more lose all their lines.
mode "rest": such keys keep the first line, by document and position.

The result is a bitmap of kept lines for each document with a line to drop, packed
and compressed; texts take no part in the range shuffle. ``cleaned`` applies the
bitmaps.

Null or empty text is one empty line. A document is a row's id and text: repeated
rows count once and get the same bitmap. Null ids sort first. Empty tables give
empty results; other columns of ``docs`` are kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import LOWER, SPACES, bound_batches, materialise, shuffle_parts, texts_of


@dataclass(frozen=True)
class Lines:
    min_docs: int = 10
    min_chars: int = 1
    mode: str = "all"


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACES).translate(LOWER) for x in text.split(b"\n")]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and tag: 64 bits that tell apart the texts of one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """hash, doc_id, tag, pos of each line whose key counts."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for i, t, tag in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                for k, key in enumerate(line_keys(t)):
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars) and (key or min_chars <= 0):
                        for column, value in zip(out, (xxhash.xxh3_128_digest(key), i, tag, k), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["hash", "doc_id", "tag", "pos"])

    return identified(docs, id_col, text_col).mapInArrow(run, "hash binary, doc_id long, tag long, pos int")


def streamed(lines: DataFrame, rule: Lines) -> DataFrame:
    """Of sorted partitions: edge, the run's documents (edges, a row each), or a line
    to drop (pos not null; sure unless its run is at an edge and too small so far)."""
    most = rule.min_docs

    def run(batches):
        current, docs, last, held, edge, first = None, 0, None, [], True, None

        def close(at_edge):
            """Rows of the run that ends: (hash, edge, docs, doc_id, tag, pos, sure, first)"""
            rows = []
            if current is None:
                return rows
            if at_edge:
                rows.append((current, True, docs, *first, False))
            if docs < most and at_edge:
                rows += [(current, False, 0, *x, False) for x in held]
            return rows

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["hash", "edge", "docs", "doc_id", "tag", "pos", "sure"])

        for b in batches:
            rows = []
            for h, *line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != current:
                    rows += close(edge)
                    edge = current is None
                    current, docs, last, held, first = h, 0, None, [], tuple(line)
                if (line[0], line[1]) != last:
                    last, docs = (line[0], line[1]), docs + 1
                    if docs == most:  # now the lines before are sure too
                        rows += [(h, False, 0, *x, True) for x in held]
                        held = []
                if docs >= most:
                    rows.append((h, False, 0, *line, True))
                else:
                    held.append(line)
            if rows:
                yield batch(rows)
        if current is not None:
            yield batch(close(True))

    return lines.mapInArrow(run, "hash binary, edge boolean, docs long, doc_id long, tag long, pos int, sure boolean")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, rule: Lines) -> DataFrame:
    """doc_id, tag, pos of each line to drop."""
    spark = docs.sparkSession
    # a few rows a document: written, as the range bounds are found by a pass of their own
    lines, _ = materialise(hashed_lines(docs, id_col, text_col, rule.min_chars), "lines")
    dealt = lines.repartitionByRange(shuffle_parts(spark), "hash", F.asc_nulls_first("doc_id"), "tag").sortWithinPartitions("hash", F.asc_nulls_first("doc_id"), "tag", "pos")
    found, _ = materialise(streamed(dealt, rule), "runs")
    # two rows a partition at most, whatever the data
    ends = found.where("edge").groupBy("hash").agg(F.sum("docs").alias("n"), F.min(F.struct("doc_id", "tag", "pos")).alias("first")).where(F.col("n") >= rule.min_docs)
    open_lines = found.where("not edge and not sure").join(F.broadcast(ends.select("hash")), "hash", "left_semi")
    gone = found.where("not edge and sure").unionByName(open_lines).select("hash", "doc_id", "tag", "pos")
    if rule.mode == "rest":
        firsts = gone.groupBy("hash").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("f")).select("f.*")
        same = [gone[c].eqNullSafe(firsts[c]) for c in ("doc_id", "tag", "pos")]
        # the same plan at every size, as below
        gone = gone.join(firsts.hint("merge"), same, "left_anti")
    return gone.select("doc_id", "tag", "pos")


def packed(dropped: list[int]) -> bytes:
    """Compressed bitmap, a set bit for a line to drop; lines beyond it are kept."""
    bits = np.zeros(max(dropped) + 1, np.uint8)
    bits[dropped] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def keep_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits == 0
    return keep


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Lines = Lines()) -> DataFrame:
    """doc_id, tag, n_dropped, bitmap of each document with a line to drop. A document's
    lines come together, no more of them than its text has."""
    bound_batches(docs.sparkSession)
    lines = dropped_lines(docs, id_col, text_col, rule).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("lines"))

    def run(batches):
        for b in batches:
            lists = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([packed(x) for x in lists], pa.binary())], ["doc_id", "tag", "n_dropped", "bitmap"])

    return lines.mapInArrow(run, "doc_id long, tag long, n_dropped long, bitmap binary")


def with_bitmap(docs: DataFrame, id_col: str, text_col: str, rule: Lines) -> DataFrame:
    """row (all columns of docs), bitmap (null: all lines stay)."""
    found = bitmaps(docs, id_col, text_col, rule).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "bitmap")
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), own.alias("tag"))
    # the same plan at every size: a sort-merge join, never a broadcast of bitmaps
    return rows.join(found.hint("merge"), rows["id"].eqNullSafe(found["_id"]) & (rows["tag"] == found["_tag"]), "left").select("row", "bitmap")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, its lines before, and how many went."""
    n = text.count(b"\n") + 1
    if not bitmap:
        return text, n, 0
    keep = keep_mask(bitmap, n)
    return b"\n".join([x for x, k in zip(text.split(b"\n"), keep.tolist(), strict=True) if k]), n, int(n - keep.sum())


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Lines = Lines()) -> DataFrame:
    """The rows of ``docs`` with the lines dropped from their text; null stays null."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for b in batches:
            row = b.column(0)
            fields = row.flatten()
            texts = [None if t is None else kept_text(t, m)[0].decode() for t, m in zip(fields[at].cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist(), strict=True)]
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, [f.name for f in row.type])

    return with_bitmap(docs, id_col, text_col, rule).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Lines = Lines()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""

    def run(batches):
        for b in batches:
            kept = [kept_text(t, m) for t, m in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = with_bitmap(docs, id_col, text_col, rule).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), F.col(f"row.{text_col}").cast("string").alias("text"), "bitmap")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
