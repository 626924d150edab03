"""Token ids in Arrow files of equal-length sequences.

The documents' ids, each with an end id, form one stream in ascending order of
document id. The table is split into ranges of ids; a range is one file of the Arrow
IPC format, whose record batches hold fixed-size lists: ``ids`` and ``mask`` (a bit
each, set for ids and not behind the last). Any sequence is a slice of a batch: ids
that numpy reads without a copy, and a view of the mask's bits. A second file has the
index: doc_id, start, n_tokens. A task writes under a name of its own and returns it;
the manifest, a written table, names the files that count, so tasks that run twice do
no harm.

A piece of text (a word with the space before it, say) is tokenised once, by the
tokenizers library, and kept; texts with special tokens go to the library whole.

Null text is the empty text: one end id. Rows of one id follow each other in the
order of their ids' bytes; null ids come first. An empty table gives no file and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archivolt.llm.common import IdRanges, bound_batches, materialise, new_path, qualified, shuffle_parts, slices, texts_of
from archivolt.llm.strings import SPACE, Store, code_points, contracted, distinct, hashes, kinds_of, ragged, run_starts

#: Pieces that a worker keeps at most; bounds its memory.
KEPT = 400_000
#: Code points of a flat array; a longer text has one of its own.
FLAT = 1 << 21
SEQUENCE = 2048
#: Sequences of a record batch.
BATCH = 64


class Encoder:
    """Ids of texts, as arrays of ``width``, by the tokenizers library.

    Texts are cut in numpy into the pieces that the library's pre-tokenizer makes; the
    different new pieces go to the library in a few long strings that it cuts the same
    way, and the ids are told apart by the bytes they stand for. Where that doesn't add
    up, each piece goes to it alone."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("not a byte-level vocabulary with its usual pieces")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None
        self.width = np.dtype(np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)
        self.bytes = np.zeros(self.whole.get_vocab_size(), np.int64)  # that an id stands for
        for token, k in self.whole.get_vocab().items():
            self.bytes[k] = len(token)
        self.kinds = kinds_of(self.whole.pre_tokenizer.pre_tokenize_str, False)
        self.pieces = Store(self.width, KEPT)

    def pieces_of(self, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where pieces begin; none goes over ``cuts``."""
        kind, n = self.kinds.of(codes), len(codes)
        begins = run_starts(kind, cuts)
        cut = np.zeros(n + 1, bool)
        cut[cuts] = True
        # white space before something else leaves its last character to it: a space is
        # part of what follows, any other is a piece
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~cut[1:n])
        begins[last] = True
        begins[last[codes[last] == 32] + 1] = False
        contracted(codes, kind, begins, cuts)
        return np.flatnonzero(begins)

    def alone(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(strings, add_special_tokens=False)]

    def together(self, strings: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces, encoded as one string with ``between`` behind each."""
        if not strings:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.array(self.alone([between.join([*strings, ""])])[0], np.int64)
        ends = np.cumsum([len(s.encode()) + len(between) for s in strings])
        upto = np.cumsum(self.bytes[ids])
        at = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != ends[-1] or (upto[at] != ends).any():
            each = self.alone(strings)
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        sizes = np.diff(np.r_[0, at + 1])
        if between:  # one id of its own
            keep = np.ones(len(ids), bool)
            keep[at] = False
            ids, sizes = ids[keep], sizes - 1
        return ids, sizes

    def learn(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces."""
        kind = np.array([0 if s[0] == " " and not s.isspace() else 2 if s.isspace() else 1 for s in strings], np.int8)
        ids, size, at, before = [], np.empty(len(strings), np.int64), np.empty(len(strings), np.int64), 0
        for k, between in enumerate(("", "\n", None)):
            mine = np.flatnonzero(kind == k)
            some = [strings[i] for i in mine.tolist()]
            if between is None:
                each = self.alone(some)
                flat, sizes = np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
            else:
                flat, sizes = self.together(some, between)
            ids.append(flat)
            size[mine], at[mine] = sizes, before + np.cumsum(sizes) - sizes
            before += len(flat)
        return ragged(np.concatenate(ids), at, size), size

    def encode_flat(self, texts: list[str]) -> list[np.ndarray]:
        text = "".join(texts)
        codes, bounds = code_points(text), np.cumsum([0, *map(len, texts)])
        starts = self.pieces_of(codes, bounds)
        ends = np.r_[starts[1:], len(codes)][: len(starts)]
        one, two = hashes(codes, starts, ends)
        first, of = distinct(one, two)

        def learnt(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = first[fresh]
            return self.learn([text[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        flat, at, size = self.pieces.runs(one[first], two[first], learnt)
        ids = ragged(flat, at[of], size[of])
        edges = np.r_[0, np.cumsum(size[of])][np.searchsorted(starts, bounds)].tolist()
        return [ids[i:j] for i, j in zip(edges, edges[1:])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        special = [k for k, t in enumerate(texts) if self.special(t)]
        plain = list(texts)
        for k in special:
            plain[k] = ""
        for a, b in slices([len(t) for t in plain], FLAT):
            out += self.encode_flat(plain[a:b])
        for k in special:
            out[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, self.width)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path with its scheme, and the path in it."""
    if uri.startswith("file:/"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


class Writer:
    """One file of sequences and one of the index, under ``folder``."""

    def __init__(self, folder: str, part: int, width: np.dtype, length: int):
        self.fs, base = opened(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        self.names = [f"{name}.arrow", f"{name}.index.arrow"]
        self.length, self.width = length, width
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(f"{base}/{n}") for n in self.names]
        self.to, self.to_index = (pa.ipc.new_file(o, s) for o, s in zip(self.outs, (self.schema, self.index), strict=True))
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = self.docs = 0

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.to_index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index))
        self.held += ids
        self.docs += len(ids)
        self.tokens += int(sizes.sum())
        self.waiting += int(sizes.sum())
        room = BATCH * self.length
        if self.waiting >= room:
            flat = np.concatenate(self.held)
            for k in range(0, len(flat) - room + 1, room):
                self.put(flat[k : k + room])
            self.held = [flat[len(flat) // room * room :]]
            self.waiting = len(self.held[0])

    def put(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.length) * self.length
        ids, mask = np.zeros(n, self.width), np.arange(n) < len(flat)
        ids[: len(flat)] = flat
        self.to.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self.put(np.concatenate(self.held))
        for x in (self.to, self.to_index, *self.outs):
            x.close()


class Reader:
    """Random access to a file's sequences and tokens; arrays are views of the file."""

    def __init__(self, folder: str, name: str):
        fs, base = opened(folder)
        path = f"{base}/{name}"
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.now = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.now[0] != k:
            self.now = (k, self.file.get_batch(k))
        return self.now[1]

    def flat(self, k: int) -> np.ndarray:
        return self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i, without a copy."""
        k, at = i // BATCH, i % BATCH * self.length
        return self.flat(k)[at : at + self.length], self.batch(k).column(1).flatten().slice(at, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        room = BATCH * self.length
        parts = [self.flat(k)[max(0, start - k * room) : start + n - k * room] for k in range(start // room, (start + n - 1) // room + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def written(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, length: int = SEQUENCE) -> list[dict]:
    """Write the files into ``folder``, which all machines share; the manifest, a dict a
    range in order: part, file, index_file, docs, tokens, base (tokens of the ranges
    before)."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = IdRanges(rows, "doc_id", shuffle_parts(spark))

    def encode(batches):
        enc = loaded(path)
        last = np.array([end], enc.width).tobytes()
        for b in batches:
            ids = [x.tobytes() + last for x in enc.encode_batch([t.decode() for t in texts_of(b.column(1))])]
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(b.column(0)).astype(np.int32)), b.column(0), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    def write(batches):
        width, out, part = loaded(path).width, None, None
        for b in batches:
            if b.num_rows:
                if out is None:
                    part = b.column(0)[0].as_py()
                    out = Writer(folder, part, width, length)
                out.add(b.column(1).to_pylist(), [np.frombuffer(x, width) for x in b.column(2).to_pylist()])
        if out is not None:
            out.close()
            row = {"part": part, "file": out.names[0], "index_file": out.names[1], "docs": out.docs, "tokens": out.tokens}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    coded = rows.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = coded.repartitionById(ranges.parts, "part").sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    manifest, _ = materialise(dealt.mapInArrow(write, "part int, file string, index_file string, docs long, tokens long"), "manifest")
    base, out = 0, []
    for r in sorted(manifest.collect()):  # a row a range
        out.append(r.asDict() | {"base": base})
        base += r["tokens"]
    return out


def read_back(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    folder = qualified(spark, folder)
    shape = "place int, file string, index_file string, base long"
    files = spark.createDataFrame([(k, m["file"], m["index_file"], m["base"]) for k, m in enumerate(manifest)], shape).repartitionById(max(1, len(manifest)), "place")

    def run(batches):
        for b in batches:
            for m in b.to_pylist():
                tokens = Reader(folder, m["file"])
                fs, base = opened(folder)
                with fs.open_input_file(f"{base}/{m['index_file']}") as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        crc = [zlib.crc32(tokens.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)]
                        starts = docs.column(1).to_numpy() + m["base"]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write, by default into the shared folder, and read back."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_back(docs.sparkSession, folder, written(docs, path, folder, **options))
