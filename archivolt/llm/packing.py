"""Packing of tokenised documents into windows, by sum of squares, online.

A document is its token ids and an end id. Whole windows of it are cut off first;
the rest goes where the sum over all fill levels of the squared number of windows
at that level grows least: a window of some level, or a new one. An array over the
levels holds these numbers. When a task's documents end, the windows not yet full
are closed without padding: the emptiest are taken apart to fill the fullest, cut
where needed, and the last one is cut into sequences whose lengths are powers of two.

Every task packs what it reads; no shuffle. The memory is that of the open windows: of
the ids that a task has read at most, two bytes each, as where all remainders are over
half a window no two of them fit together; the split of the input bounds it. Sequence ids are those of the task, 2^32 apart; a task run again gives the
same. Null text is the empty text: one end id. Repeated rows and null ids are
packed like any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, texts_of
from archivolt.llm.word_bpe import loaded

#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Windows of ``size`` tokens; ``add`` returns the sequences that got full."""

    def __init__(self, size: int):
        self.size = size
        self.gain = np.full(size + 1, -(1 << 40), np.int64)  # squares saved by taking a window from a level
        self.gain[0] = 0
        self.cost = np.ones(size + 1, np.int64)  # squares added by one more window at a level
        self.cost[size] = 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(size)]

    def set_level(self, level: int) -> None:
        n = len(self.open[level])
        self.gain[level] = 2 * n - 1 if n else -(1 << 40)
        self.cost[level] = 2 * n + 1

    def level_for(self, n: int) -> int:
        """The level, 0 for a new window, that n tokens go to; of equals, the fullest."""
        growth = self.cost[n:] - self.gain[: self.size + 1 - n]
        return len(growth) - 1 - int(np.argmin(growth[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[list[Piece]]:
        total, done, start = len(ids), [], 0
        while total - start >= self.size:
            done.append([(doc_id, start, ids[start : start + self.size], total)])
            start += self.size
        if start < total:
            level = self.level_for(total - start)
            window = self.open[level].pop() if level else []
            window.append((doc_id, start, ids[start:], total))
            filled = level + total - start
            if level:
                self.set_level(level)
            if filled == self.size:
                done.append(window)
            else:
                self.open[filled].append(window)
                self.set_level(filled)
        return done

    def close(self) -> Iterator[list[Piece]]:
        """The open windows as full sequences and some whose lengths are powers of two."""
        left = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.__init__(self.size)
        low, high = 0, len(left) - 1
        while low < high:
            filled, window = left[low]
            have, donor = left[high]
            while filled < self.size and donor:
                doc, start, ids, total = donor.pop()
                room = self.size - filled
                if len(ids) > room:
                    donor.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc, start, ids, total))
                filled, have = filled + len(ids), have - len(ids)
            if donor:
                left[high] = (have, donor)
            else:
                high -= 1
            if filled == self.size:
                yield window
                low += 1
            else:
                left[low] = (filled, window)
        if low == high:
            pieces = left[low][1][::-1]
            rest = left[low][0]
            while rest:
                want = 1 << (rest.bit_length() - 1)
                rest -= want
                window, room = [], want
                while room:
                    doc, start, ids, total = pieces.pop()
                    if len(ids) > room:
                        pieces.append((doc, start + room, ids[room:], total))
                        ids = ids[:room]
                    window.append((doc, start, ids, total))
                    room -= len(ids)
                yield window


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of little-endian 4-byte integers), doc_tokens, sequence_id, offset, and
    with ``with_ids`` its ids as such integers."""
    bound_batches(docs.sparkSession)
    names = [*COLUMNS, "ids"] if with_ids else COLUMNS

    def batch(windows, first):
        rows = []
        for k, window in enumerate(windows, first):
            at = 0
            for doc, start, ids, total in window:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, k, at, raw))
                at += len(ids)
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 7 else pa.binary()) for k, c in enumerate(cols[: len(names)])], names)

    def run(batches):
        bpe, packer, number = loaded(path), Packer(size), TaskContext.get().partitionId() << 32
        for b in batches:
            full = []
            ids = bpe.encode_batch([t.decode() for t in texts_of(b.column(1))])
            for doc, x in zip(b.column(0).to_pylist(), ids, strict=True):
                full += packer.add(doc, np.append(x, bpe.width.type(end)))
            if full:
                yield batch(full, number)
                number += len(full)
        if full := list(packer.close()):
            yield batch(full, number)

    schema = ", ".join([*(f"{c} long" for c in COLUMNS), *(["ids binary"] if with_ids else [])])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
