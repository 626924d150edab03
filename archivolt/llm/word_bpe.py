"""BPE encoding and decoding with a vocabulary of word ends, in numpy.

Texts are split at white space in one flat array of code points; what is between is
encoded once for each different string and kept (``strings.Store``). The new strings
of a batch are normalised, cut into words, and the different new words' symbols put
into one flat array. A round finds the rank of each neighbouring pair by binary
search over the sorted pair keys, takes each word's lowest rank, and merges that pair
throughout the word; words without a pair to merge leave the array. Ids and decoded
text are those of the tokenizers library for the same file (its normaliser is used,
its model is not).

All occurrences of a pair can be merged at once only if a merge never makes a
pair of a lower rank; the ranks of which this does not hold are found when the
file is read, and of those the leftmost occurrence alone is merged in a round.

Null text is the empty text, with no ids. Strings of special tokens within a text
become their ids, as in the library. A text longer than ``FLAT`` is a batch of its own,
whole. Each row is encoded by itself: repeated rows, ties and null ids make no
difference; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archivolt.llm.common import bound_batches, slices, texts_of
from archivolt.llm.strings import NUMBER, Store, code_points, contracted, distinct, hashes, kinds_of, ragged, run_starts

NONE = np.iinfo(np.int32).max
#: Strings, and words, that a worker keeps at most; bounds its memory.
KEPT = 400_000
#: Code points of a flat array; a longer text has one of its own.
FLAT = 1 << 21
#: What \\s is among the code points.
WHITE = np.zeros(0x3002, bool)
WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        lowest = np.full(len(self.tokens), NONE, np.int64)
        rank = np.arange(len(pairs))
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.at_once = lowest[made] > rank
        library = Tokenizer.from_file(path)
        self.normal, self.kinds = library.normalizer, kinds_of(library.pre_tokenizer.pre_tokenize_str, True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.width = np.dtype(np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32)
        self.strings, self.words = Store(self.width, KEPT), Store(self.width, KEPT)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (their UTF-8) one after another, and how many each has, by
        merge rounds over all of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, wid = self.inner[flat], np.repeat(np.arange(len(words), dtype=np.int32), size)
        ends = np.cumsum(size)[size > 0] - 1
        sym[ends] = self.last[flat[ends]]
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(wid[:-1] == wid[1:])
        rank[inside] = self.rank_of(sym[inside], sym[inside + 1])
        ready_sym, ready_wid = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
            best = np.minimum.reduceat(rank, starts)
            low = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            if (best == NONE).any():
                gone = low == NONE
                ready_sym.append(sym[gone])
                ready_wid.append(wid[gone])
                sym, wid, rank, low = sym[~gone], wid[~gone], rank[~gone], low[~gone]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # of overlapping pairs every other one, from the left
            run = np.r_[0, np.flatnonzero(np.diff(hit) != 1) + 1]
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            one = ~self.at_once[rank[hit]]
            if one.any():
                first = np.r_[True, wid[hit[1:]] != wid[hit[:-1]]]
                hit = hit[~one | first]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            new = (np.cumsum(stay) - 1)[hit]
            sym, wid, rank = sym[stay], wid[stay], rank[stay]
            rank[new] = NONE
            for at in (new[new + 1 < len(sym)], new[new > 0] - 1):
                pair = at[wid[at] == wid[at + 1]]
                rank[pair] = self.rank_of(sym[pair], sym[pair + 1])
        wid = np.concatenate(ready_wid)
        order = np.argsort(wid, kind="stable")
        return np.concatenate(ready_sym)[order], np.bincount(wid, minlength=len(words))

    def normalised(self, strings: list[str]) -> list[str]:
        """By the library's normaliser; what is ASCII is only lower-cased by it."""
        if not strings:
            return []
        joined = "\n".join(strings)
        if joined.isascii():
            return joined.lower().split("\n")
        out = self.normal.normalize_str(joined).split(" ")
        return out if len(out) == len(strings) else [self.normal.normalize_str(s) for s in strings]

    def learn(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of strings without white space."""
        plain = [s.isascii() for s in strings]
        one, two = (iter(self.normalised([s for s, p in zip(strings, plain, strict=True) if p == which])) for which in (True, False))
        normal = [next(one) if p else next(two) for p in plain]
        text = "".join(normal)
        codes, bounds = code_points(text), np.cumsum([0, *map(len, normal)])
        kind = self.kinds.of(codes)
        begins = run_starts(kind, bounds[:-1])
        begins |= kind == NUMBER
        contracted(codes, kind, begins, bounds)
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(codes)][: len(starts)]
        one, two = hashes(codes, starts, ends)
        first, of = distinct(one, two)

        def merged(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = first[fresh]
            return self.merge([text[i:j].encode() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        flat, at, size = self.words.runs(one[first], two[first], merged)
        total = np.r_[0, np.cumsum(size[of])]
        return ragged(flat, at[of], size[of]), np.diff(total[np.searchsorted(starts, bounds)])

    def encode_flat(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens, that fit one flat array."""
        text = "".join(texts)
        codes, bounds = code_points(text), np.cumsum([0, *map(len, texts)])
        inside = np.r_[False, ~WHITE[np.minimum(codes, len(WHITE) - 1)], False]
        cut = np.zeros(len(codes) + 2, bool)
        cut[bounds + 1] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1
        one, two = hashes(codes, starts, ends)
        first, of = distinct(one, two)

        def learnt(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = first[fresh]
            return self.learn([text[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        flat, at, size = self.strings.runs(one[first], two[first], learnt)
        ids = ragged(flat, at[of], size[of])
        edges = np.r_[0, np.cumsum(size[of])][np.searchsorted(starts, bounds)].tolist()
        return [ids[i:j] for i, j in zip(edges, edges[1:])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as an array of ``width``."""
        out: list[np.ndarray] = []
        cut = self.cut
        special = [k for k, t in enumerate(texts) if cut and "<|" in t and cut.search(t)]
        plain = list(texts)
        for k in special:
            plain[k] = ""
        for a, b in slices([len(t) for t in plain], FLAT):
            out += self.encode_flat(plain[a:b])
        for k in special:
            pieces = cut.split(texts[k])
            between = iter(self.encode_batch([x for x in pieces if x not in self.special]))
            out[k] = np.concatenate([np.array([self.special[x]], self.width) if x in self.special else next(between) for x in pieces])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, a space between: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned integers of 2 bytes, of 4 for vocabularies
    over 65,536; little-endian) and decoded text of each row; with ``digests``
    instead of these two ids_sha256 (of 4-byte integers) and decoded_sha256."""
    bound_batches(docs.sparkSession)
    last = ["ids_sha256 string", "decoded_sha256 string"] if digests else ["ids binary", "decoded string"]

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            texts = [t.decode() for t in texts_of(b.column(1))]
            ids = bpe.encode_batch(texts)
            n = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                one = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                two = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            else:
                one, two = [x.tobytes() for x in ids], [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), n, pa.array(one, pa.string() if digests else pa.binary()), pa.array(two, pa.string())], ["doc_id", "n_tokens", *(x.split()[0] for x in last)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *last]))
