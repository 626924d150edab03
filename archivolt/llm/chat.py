"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation many times, each time with more turns. Every turn
gets the rolling hash of all turns up to it. A conversation whose last hash is the
hash of an earlier turn elsewhere is a prefix of a longer one; an anti-join on these
hashes leaves the maximal conversations, of equal ones that with the smallest id.
Only these are rendered. The hashes on both sides of the anti-join are made distinct
first, with partial aggregation, so a first turn that millions of conversations share
is one row.

Turns are in the order of turn (nulls first), role, text. Null role or text is the
empty string. A null conversation id is an id like any other, and sorts last when
equal conversations are compared. Repeated rows are repeated turns. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, materialise


def turns_of(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    empty = F.lit("")
    return chats.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))


def rolling(before: bytes, role: str, text: str) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(before + len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1), hash of the turns up to the k-th, last. The conversations
    are streamed, none is held."""
    bound_batches(turns.sparkSession)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", "k", "hash", "last"]

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        waiting = None  # the turn that may be its conversation's last
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                same = waiting is not None and waiting[0] == conv
                if waiting is not None:
                    rows.append((*waiting, not same))
                waiting = (conv, waiting[1] + 1, rolling(waiting[2], role, text)) if same else (conv, 1, rolling(b"", role, text))
            if rows:
                yield batch(rows)
        if waiting is not None:
            yield batch([(*waiting, True)])

    return dealt.mapInArrow(run, "conv_id long, k long, hash binary, last boolean")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one continues."""
    hashes, _ = materialise(turn_hashes(turns), "turns")
    whole = hashes.where("last").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.min("k").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.where("not last").select("hash").distinct()
    return whole.join(inner, "hash", "left_anti").select("conv_id", "n_turns", "n_copies")


def prefixes(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, within: each conversation that is left out, and the maximal one with the
    smallest id that continues it or equals it."""
    hashes, _ = materialise(turn_hashes(turns_of(chats, conv, turn, role, text)), "turns")
    inner = hashes.where("not last").select("hash").distinct()
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first")
    kept = hashes.where("last").groupBy("hash").agg(least).join(inner, "hash", "left_anti").select("hash", F.col("first.conv_id").alias("within"), F.col("first.none").alias("none"))
    own = hashes.join(kept.select(F.col("within").alias("_id"), "none"), hashes["conv_id"].eqNullSafe(F.col("_id"))).where("not last")
    longer = own.groupBy("hash").agg(least).select("hash", F.col("first.conv_id").alias("within"))
    ends = hashes.where("last").select("conv_id", "hash")
    covered = ends.join(longer.unionByName(kept.select("hash", "within")), "hash")
    return covered.where(~F.col("conv_id").eqNullSafe(F.col("within"))).select("conv_id", "within")


def formatted(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, chat (the rendered text) of each maximal one."""
    turns = turns_of(chats, conv, turn, role, text)
    kept = maximal(turns).withColumnRenamed("conv_id", "_conv")
    lines = turns.join(kept, turns["conv_id"].eqNullSafe(kept["_conv"]))
    one = lines.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("t"))
    said = F.transform("t", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n")))
    return one.select("conv_id", "n_turns", "n_copies", F.concat_ws("", said).alias("chat"))
