"""The stages of the pipeline on small tables."""

import random

import corpus_pipeline

from archivolt.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def sentence(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_one_of_many_copies_survives_the_line_stage(spark):
    copies = [(100 * g + k, f"{sentence(g)}\n{sentence(g + 50)}") for g in range(2) for k in range(12)]
    docs = table(spark, [*copies, (900, sentence(99))])
    cleaned = corpus_pipeline.lines(spark, docs, "").cache()
    assert {(r.doc_id, r.text) for r in cleaned.collect() if r.text} == {copies[0], copies[12], (900, sentence(99))}
    left = corpus_pipeline.near_duplicates(spark, cleaned, "").collect()
    assert sorted(r.text for r in left if r.text) == sorted([copies[0][1], copies[12][1], sentence(99)])


def test_rows_without_an_id_or_with_the_same_id_stay(spark):
    rows = [(None, sentence(1)), (None, sentence(2)), (None, sentence(2)), (5, sentence(3)), (5, sentence(4)), (5, sentence(4)), (6, sentence(3)), (7, None), (8, "")]
    left = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect() if r.text)
    assert left == sorted([("None", sentence(1)), ("None", sentence(2)), ("5", sentence(3)), ("5", sentence(4))])


def plain_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def changed(text, at):
    w = text.split()
    return " ".join(f"new{k}" if k in at else x for k, x in enumerate(w))


def test_near_copies_are_those_of_similarity_0_8(spark):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = sentence(g, 150)
        # a chain, of which the last is like the third only, and a text that is near but not enough
        a, b = changed(base, {20, 90}), changed(base, {20, 90, 130})
        texts += [base, a, b, changed(b, {5, 50, 70}), changed(sentence(g + 100, 150), {30}), changed(sentence(g + 100, 150), {10, 40, 60, 80, 100, 120})]
    crowd = sentence(77, 200)
    texts += [changed(crowd, set(rng.sample(range(200), 3))) for _ in range(60)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and plain_jaccard(texts[i], texts[j]) >= 0.8:
                group = [group[j] if x == group[i] else x for x in group]
    want = sorted(min(i for i, y in enumerate(group) if y == x) for x in set(group))
    left = corpus_pipeline.near_duplicates(spark, table(spark, enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in left) == want
    assert len(want) < 60


def test_no_near_copies(spark):
    assert near_copies.one_of_each(table(spark, [(1, sentence(1)), (2, sentence(2))])).count() == 2
    assert near_copies.one_of_each(table(spark, [(1, "a")]).where("false")).count() == 0


def tables(spark, folder, rows, labels, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_pipeline_with_nulls_repeats_and_other_columns(spark, tmp_path):
    own = [(k, sentence(k), "en", "s", 1, "x", 2.0) for k in range(30)]
    odd = [(None, None, None, None, None, None, None), (None, sentence(200), None, None, None, None, None), (31, "", "en", "s", 0, "x", None), (5, sentence(5), "en", "s", 1, "x", 2.0), (6, sentence(300), "en", "s", 1, "y", 1.0), (40, sentence(7), "de", "t", 1, "x", 2.0)]
    labels = [(k, 1, 0) for k in range(8)]
    schema = f"{SCHEMA}, tag string, root double"
    folder = tables(spark, tmp_path, own + odd, labels, schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema
        docs = docs.cache()
    # quality rules: null and empty go; no fitted classifier: all are kept; near copies: 40 and the repeated row go
    left = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert left == sorted([(str(k), sentence(k)) for k in range(30)] + [("None", sentence(200)), ("6", sentence(300))])
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert len(packed[packed.length == packed.doc_tokens].doc_id) <= len(left) and packed.length.sum() > 0
    by_doc = packed.drop_duplicates(["doc_id", "doc_tokens"])
    assert len(by_doc) == len(left)


def test_distances_are_those_of_all_pairs():
    import numpy as np

    rng = random.Random(9)
    base = sentence(1, 120)
    texts = [changed(base, set(rng.sample(range(120), rng.randrange(0, 6)))) for _ in range(40)] + [sentence(k, 100 + k) for k in range(20)]
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    row = {"tile": 0, "level": 0, "set": np.arange(60).tobytes(), "root": np.arange(60).tobytes(), "n": np.array([len(s) for s in sets], np.int32).tobytes(), "sign": b"".join(map(near_copies.signature, sets))}
    tile = near_copies.Tile(row)
    seen = {}
    for k, d in near_copies.distances(tile, tile):
        for i, j in zip(*np.nonzero(d < near_copies.FAR)):
            seen[k + i, j] = int(d[i, j])
    signs = [int.from_bytes(near_copies.signature(s), "little") for s in sets]
    for i in range(60):
        for j in range(60):
            d = (signs[i] ^ signs[j]).bit_count()
            sizes = 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
            first = ((signs[i] ^ signs[j]) & (1 << 128) - 1).bit_count()
            assert seen.get((i, j)) == (d if i != j and sizes and d <= near_copies.RADIUS and first <= near_copies.RADIUS_FIRST else None)
            # nothing that is alike is missed
            if i != j and near_copies.alike(sets[i], sets[j]):
                assert (i, j) in seen
