"""Quality classifier from compressed sizes.

Two zstandard dictionaries are built, of labelled texts of either kind. A text is
compressed with each; the difference of the sizes over their sum, with the size for
its length, goes through a logistic curve fitted on labelled texts that are in
neither dictionary, weighted to the labels' true shares. The score is the
probability of label 1.

The model is fitted on a bounded sample: of the rows that may be learnt from, the
``per_class`` first of each label by a hash of their id; those of them longer than
``max_chars`` are left out, none is cut. All texts are scored, whole.

Null text is the empty text and gets a score too. Labels that are null or contradict
each other for one id, and ids that are null, are not learnt from. Without labelled
rows of both kinds, or too few for dictionaries, each text gets the smoothed share
of label 1. Repeated rows get the same score. An empty table gives an empty result;
other columns are ignored, or kept by ``passing``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, texts_of


@dataclass(frozen=True)
class Fit:
    per_class: int = 3000
    max_chars: int = 40_000
    dictionary_bytes: int = 112_640
    level: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    level: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.bad, model.good):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    bad, good = ([len(c.compress(t)) for t in texts] for c in compressors(model))
    bad, good = np.array(bad, float), np.array(good, float)
    n = np.array([len(t) + 1 for t in texts], float)
    ratio = good / n
    return np.column_stack([(bad - good) / (bad + good), ratio, np.minimum(ratio, 0.3), np.log(n)]) if texts else np.empty((0, 4))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic curve by Newton steps, with a slight ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-3 * b)
    return b


def fit(good: list[bytes], bad: list[bytes], share: float, how: Fit = Fit()) -> Model | None:
    """Of each kind, every other text for the dictionary and the rest for the curve;
    ``share`` is that of label 1 among all. None if there are too few."""
    if min(len(good), len(bad)) < 20:
        return None
    try:
        made = [zstandard.train_dictionary(how.dictionary_bytes, texts[::2], k=200, d=8).as_bytes() for texts in (bad, good)]
    except zstandard.ZstdError:
        return None
    plain = Model(*made, how.level, (0.0,) * 4, (1.0,) * 4, (0.0,) * 5)
    x = features(plain, good[1::2] + bad[1::2])
    n, m = len(good[1::2]), len(bad[1::2])
    y = np.r_[np.ones(n), np.zeros(m)]
    w = np.r_[np.full(n, share / n), np.full(m, (1 - share) / m)] * (n + m)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights = logistic(np.column_stack([np.ones(n + m), (x - mean) / scale]), y, w)
    return Model(*made, how.level, *(tuple(v.tolist()) for v in (mean, scale, weights)))


def score(model: Model | float, texts: list[bytes]) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(texts), model)
    x = (features(model, texts) - np.array(model.mean)) / np.array(model.scale)
    z = model.weights[0] + x @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(ids) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", how: Fit = Fit()) -> Model | float:
    """The model, from rows that are not held out."""
    ids = F.col(id_col).cast("long")
    known = labels.select(ids.alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    # the sample's bound is also that of the broadcast and of what comes to the driver
    sample = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(how.per_class) for y in (0, 1)]
    wanted = F.broadcast(sample[0].unionByName(sample[1]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(ids.alias("id"), text.alias("t")).where(F.length("t") <= how.max_chars).join(wanted, "id")
    one = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("t").alias("t"))
    got = sorted(((zlib.crc32(str(r["id"]).encode()), r["id"], r["y"], r["t"].encode()) for r in one.toLocalIterator()))
    model = fit([t for *_, y, t in got if y], [t for *_, y, t in got if not y], share, how)
    return share if model is None else model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels, id_col, text_col, label_col, how))

    def run(batches):
        for b in batches:
            s = score(model.value, texts_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= how.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = F.col(id_col).cast("long")
    return docs.select(ids, held_out(ids), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", how: Fit = Fit()) -> DataFrame:
    """The rows predicted to be good, with all their columns. Only texts go to Python."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels, id_col, text_col, label_col, how))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(score(model.value, texts_of(texts)) >= how.threshold)

    return docs.where(good(F.col(text_col).cast("string")))
