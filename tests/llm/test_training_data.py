"""The operators against plain versions on a small table with nulls, empty and long
texts, ties, repeated rows, extra columns of clashing names, and on empty tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archivolt.llm import chat, classifier, common, fingerprints, line_dedup, lm_score, packing, quality_rules, queries, simhash, strings, token_files, word_bpe

SF = "/root/testdata/sf0.001"
WORDS = "der Fluss ran über the stone mill, año «nuevo» & café 12 it's we'll λόγος ΣΑΣ naïve".split()
SCHEMA = "doc_id long, text string, hash int, fp int, tag int, _row int, bitmap int, k int"


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ".", "", str(rng.randrange(99))]) for _ in range(n))
    base = [say(60) for _ in range(12)]
    near = [" ".join([*b.split()[:-1], "end"]) for b in base[:5]]
    long = say(6000)
    shared = ["Shared  Line "] * 0 + [f"{say(5)}\n shared LINE\t\n{say(5)}\n\n" for _ in range(11)]
    odd = [None, "", " \n\t", "one", "ß\x1cx\x85y z", "a" * 5000, "De " * 300, base[0], "<|endoftext|> x<|startoftext|>", "   two  spaces\n\n end ", "é́\u0000 null"]
    return base + near + [long, long] + shared + odd


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(7 * k % 101, x) for k, x in enumerate(t)]
    return [*out, out[0], out[-1], (None, "no id at all here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return regex.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_fingerprint(t):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, rows, none):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted((str(i), p, str(least[g])) for (i, _), p, g in zip(rows, prints, group, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({str(x) for x in least.values()})
    assert simhash.near_duplicates(none).count() == 0


def test_links_over_many_blocks(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(2)] + [0, 1, (1 << 64) - 1]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    fps = spark.createDataFrame([(k, v) for k, v in enumerate(signed)], "doc_id long, fp long")
    tiled = simhash.tiles(fps.select("fp"), 8).cache()
    assert tiled.count() > 40 and sorted(v for r in tiled.collect() for v in np.frombuffer(r.vals, np.int64).tolist()) == signed
    got = {r.node: r.root for r in simhash.connected(simhash.links(tiled)).collect()}
    root = {v: v for v in signed}
    for v in signed:
        for w in signed:
            if (v ^ w).bit_count() <= 4 if v >= 0 and w >= 0 else ((v ^ w) & (1 << 64) - 1).bit_count() <= 4:
                a, b = root[v], root[w]
                if a != b:
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert {v: got.get(v, v) for v in signed} == root and len(set(root.values())) < len(signed) - 100


def test_near_pairs_in_blocks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = np.concatenate([x[:40] ^ np.uint64(0b10011), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    i, j = simhash.near(x, y, 4)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(300) for b in range(140) if (int(x[a]) ^ int(y[b])).bit_count() <= 4}


def test_repeats_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        all_docs = [[rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(4)]
        flat, doc = np.array([w for x in all_docs for w in x]), np.repeat(np.arange(4), [len(x) for x in all_docs])
        want = []
        for x in all_docs:
            for i in range(len(x)):
                want.append(max((next((k for k in range(len(x)) if max(i, j) + k >= len(x) or x[i + k] != x[j + k]), len(x)) for j in range(len(x)) if j != i), default=0))
        assert quality_rules.longest_repeats(doc, flat).tolist() == want


def test_quality_rules(docs, rows, none):
    got = {str(r.doc_id) + str(r.n_words): r for r in quality_rules.judged(docs).collect()}
    for i, t in rows:
        w = words(t)
        r = got[str(i) + str(len(w))]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)
    passed = quality_rules.passing(docs)
    assert passed.columns == docs.columns and 0 < passed.count() < docs.count() and quality_rules.judged(none).count() == 0


@pytest.mark.parametrize("mode", ["all", "rest"])
def test_line_dedup(docs, rows, none, mode):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    found, first = {}, {}
    for i, t in {(i, t or "") for i, t in rows}:
        for k, x in enumerate(t.split("\n")):
            found.setdefault(key(x), set()).add((i, t))
            place = (i is not None, i or 0, t, k)
            first[key(x)] = min(first.get(key(x), place), place)
    rule = line_dedup.Lines(min_docs=10, mode=mode)

    def kept(i, t):
        out = [x for k, x in enumerate(t.split("\n")) if not (key(x) and len(found[key(x)]) >= 10) or mode == "rest" and first[key(x)][:2] == (i is not None, i or 0) and first[key(x)][3] == k]
        return "\n".join(out)

    want = sorted((str(i), (t or "").count("\n") + 1, hashlib.sha256(kept(i, t or "").encode()).hexdigest()) for i, t in rows)
    got = line_dedup.digests(docs, rule=rule).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.kept_sha256) for r in got) == want and sum(r.n_dropped for r in got) > 0
    out = line_dedup.cleaned(docs, rule=rule)
    assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == sorted(str(t if t is None else kept(i, t)) for i, t in rows)
    assert line_dedup.digests(none).count() == 0


def test_very_frequent_line_over_many_partitions(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "common").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    assert sorted(r.doc_id for r in line_dedup.digests(many).where("n_dropped > 0").collect()) == list(range(0, 3000, 3))


def test_word_bpe_is_the_library(docs, rows, none):
    path = public_tokenizers.path(queries.WORD_BPE)
    lib = Tokenizer.from_file(path)
    want = sorted((str(i), ids, lib.decode(ids, skip_special_tokens=False)) for i, t in rows for ids in [lib.encode(t or "", add_special_tokens=False).ids])
    got = word_bpe.encoded(docs, path).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, np.uint16).tolist(), r.decoded) for r in got) == want
    assert word_bpe.encoded(none, path).count() == 0


def test_token_files_round_trip(docs, rows, none):
    path = public_tokenizers.path(queries.BYTE_BPE)
    lib, at, want = Tokenizer.from_file(path), 0, []
    coded = [(i, lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], np.uint16).tobytes())):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.round_trip(docs, path, length=64).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_files.round_trip(none, path).count() == 0


def test_sequences_without_a_copy(tmp_path):
    w = token_files.Writer(f"file:{tmp_path}", 0, np.dtype(np.uint16), 8)
    w.add([1, 2], [np.arange(13, dtype=np.uint16), np.arange(5, dtype=np.uint16)])
    w.close()
    r = token_files.Reader(f"file:{tmp_path}", w.names[0])
    ids, mask = r.sequence(2)
    assert r.sequence(1)[0].tolist() == [8, 9, 10, 11, 12, 0, 1, 2] and ids.tolist() == [3, 4, 0, 0, 0, 0, 0, 0] and mask.to_pylist() == [True] * 2 + [False] * 6
    assert not ids.flags.owndata and r.tokens(11, 4).tolist() == [11, 12, 0, 1]


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, rows, none, size):
    path = public_tokenizers.path(queries.WORD_BPE)
    lib = Tokenizer.from_file(path)
    got = packing.packed(docs, path, size=size, with_ids=True).toPandas()
    windows = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= size
        windows.append(int(g.length.sum()))
    assert all(n & (n - 1) == 0 for n in windows)  # no padding at all
    ids = sorted(tuple(lib.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    assert sorted(x for x in got.length) and got.length.sum() == sum(map(len, ids))
    once = got[got.length == got.doc_tokens]
    assert {tuple(np.frombuffer(x, "<u4").tolist()) for x in once.ids} <= set(ids)
    for i, t in {(i, t) for i, t in rows if i is not None and sum(i == j for j, _ in rows) == 1}:
        mine = got[got.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert packing.packed(none, path).count() == 0


def test_level_with_least_squares():
    p, rng = packing.Packer(16), random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 16)
        count = [len(x) for x in p.open] + [0]

        def squares(level, n=n, count=count):
            c = list(count)
            if level:
                c[level] -= 1
            c[level + n] += 1
            return sum(x * x for x in c[1:16])

        options = [h for h in range(16 - n + 1) if h == 0 or count[h]]
        assert squares(p.level_for(n)) == min(map(squares, options))
        p.add(1, np.zeros(n, np.uint16))


def test_fingerprints(docs, rows, none):
    got = fingerprints.against_next(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        want.append((str(i), len(t), hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in fingerprints.fingerprints(docs).collect():
        by_text.setdefault(r.fingerprint, set()).add(next(t or "" for i, t in rows if i == r.doc_id and (fingerprints.fingerprint_batch([t or ""])[0] == r.fingerprint)))
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) == len({t or "" for _, t in rows})
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next)) and fingerprints.against_next(none).count() == 0


def test_spans_and_extensions():
    rng = random.Random(8)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = a[40:200] + "x" + a[:60]
    x, y = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in (a, b))
    for _ in range(300):
        i, k, n = rng.randrange(300), rng.randrange(len(b)), rng.randrange(30)
        assert x.equal(i, y, k, n) == (a[i : i + n] == b[k : k + n] and i + n <= 300 and k + n <= len(b))
        want = next((m for m in range(300) if a[i + m : i + m + 1] != b[k + m : k + m + 1] or not a[i + m : i + m + 1]), 300)
        assert x.extension(i, y, k) == want
    one, two = fingerprints.fingerprint_batch(["abc" * 200, "abc" * 100 + "xyz" * 100])
    assert fingerprints.likeness(one, one) == 1 and 0.4 < fingerprints.likeness(one, two) < 0.55


@pytest.mark.parametrize("places", [[0], [0.5], [1], [0, 1], [0, 0.3, 0.6, 1], [0.1, 0.2, 0.4, 0.5, 0.7, 0.9]])
def test_likeness_is_near_what_is_shared(places):
    rng = random.Random(len(places))
    step = fingerprints.STRIDE
    got = []
    for _ in range(8):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
        at = sorted(min(len(text) - 7, int(len(text) * p)) for p in places)
        changed = text
        for i in at:
            changed = changed[:i] + "XYZ QZX" + changed[i + 7 :]
        # what is shared, by brute force: all but the code points put in
        shared = sum(a == b for a, b in zip(text, changed, strict=True)) / len(text)
        one, two = fingerprints.fingerprint_batch([text, changed])
        got.append(shared - fingerprints.likeness(one, two))
    assert min(got) >= -1e-9 and sum(got) / len(got) <= 3 * step * len(places) / 20_000


def test_moved_passages_and_strangers():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    one, two, passage = say(2000), say(2000), say(2000)
    prints = fingerprints.fingerprint_batch([one + passage, passage + two, one, two, "a" * 50_000, "a" * 49_000])
    assert 0.42 < fingerprints.likeness(prints[0], prints[1]) < 0.52 and fingerprints.likeness(prints[2], prints[3]) < 0.01
    assert len(prints[4]) < 2000 and fingerprints.likeness(prints[4], prints[5]) > 0.9


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.scored(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.9
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)


def test_classifier_without_labels(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.scored(docs, labels).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert classifier.scored(none, labels).count() == 0 and classifier.passing(docs, labels).columns == docs.columns


LM_SHAPE = lm_score.Shape(words_factor=2.0, hidden=6)


def plain_classes(p, v, h):
    """The probability of each class: that of its group, times that within the group."""
    groups, classes = np.exp(h @ p["u"] + p["c"]), np.exp(h @ p["v"] + p["d"])
    out = np.empty(v.classes)
    for k, (a, b) in enumerate(zip(v.bounds[:-1], v.bounds[1:], strict=True)):
        out[a:b] = groups[k] / groups.sum() * classes[a:b] / classes[a:b].sum()
    return out


def plain_scores(model, texts):
    """Sums of log-probabilities, a word at a time."""
    v, p = model.vocabulary, lm_score.split(model.flat, model.vocabulary, model.shape)
    place = {int(h): k for k, h in enumerate(v.words)}
    split = [t.encode().split() for t in texts]

    def hashed(word):
        w = lm_score.Words([word])
        return int(w.hash[0]), int(w.second[0])

    seen = {w: hashed(w) for ws in split for w in ws}
    spans = []
    for ws in split:
        cuts = [0, *(k + 1 for k, w in enumerate(ws[:-1]) if seen[w][1] % lm_score.SPAN == 0), len(ws)]
        spans.append([(a, b) for a, b in zip(cuts, cuts[1:]) if a < b])
    often = {}
    for ws, ss in zip(split, spans, strict=True):
        for a, b in ss:
            often[tuple(ws[a:b])] = often.get(tuple(ws[a:b]), 0) + 1
    out = []
    for ws, ss in zip(split, spans, strict=True):
        index, total = [place.get(seen[w][0], v.size) for w in ws], 0.0
        for a, b in ss:
            others = max((k for k in lm_score.OTHERS if k < often[tuple(ws[a:b])]), default=0)
            for k in range(a, b):
                around = [index[k + o] if 0 <= k + o < len(ws) else v.size + 1 for o in lm_score.OFFSETS]
                x = np.concatenate([p["e"][i] for i in around]).astype(float)
                prob = plain_classes(p, v, np.tanh(x @ p["w"] + p["b"]))[v.of[index[k]]] * np.exp(v.share[index[k]])
                if index[k] == v.size:
                    word = [lm_score.START, *ws[k], lm_score.START]
                    prob *= np.exp(sum(v.spelling[i * lm_score.BYTES + j] for i, j in zip(word, word[1:])))
                total += np.log(prob / (others + 1) + others / (others + 1))
        out.append(total)
    return out


def test_lm_scores_are_the_sums_of_log_probabilities(spark, docs, rows, none):
    model = lm_score.fitted(docs.select("doc_id", "text"), LM_SHAPE)
    got = lm_score.scored(docs, shape=LM_SHAPE, model=model).collect()
    texts = [t or "" for _, t in rows]
    want = [(str(i), len(t.encode().split()), s) for (i, _), t, s in zip(rows, texts, plain_scores(model, texts), strict=True)]
    have = [(str(r.doc_id), r.n_words, r.log_likelihood) for r in got]
    assert sorted(x[:2] for x in have) == sorted(x[:2] for x in want)
    assert np.allclose(sorted(x[2] for x in have), sorted(x[2] for x in want), rtol=1e-4, atol=1e-2)
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) and (r.n_words or r.log_likelihood == 0) for r in got)
    assert lm_score.scored(none, shape=LM_SHAPE).count() == 0
    # the model's probabilities of classes, shares and spellings are distributions
    v = model.vocabulary
    p, rng = lm_score.split(model.flat, v, model.shape), np.random.default_rng(1)
    for h in rng.uniform(-1, 1, (5, LM_SHAPE.hidden)):
        every = lm_score.class_logs(p, v, np.repeat(h[None, :], v.classes, 0), np.arange(v.classes))
        assert np.isclose(np.exp(every).sum(), 1) and np.allclose(np.exp(every), plain_classes(p, v, h), atol=1e-6)
    assert all(r.network_log_likelihood <= r.log_likelihood + 1e-6 for r in got)
    assert np.allclose(np.bincount(v.of[:-1], np.exp(v.share[:-1]), minlength=v.classes)[:-1], 1)
    assert np.allclose(np.exp(v.spelling).reshape(lm_score.BYTES, -1).sum(axis=1), 1)


def test_lm_counts_are_those_of_all_words(docs, rows):
    counts = {r.word: r.n for r in lm_score.word_counts(docs.select("doc_id", "text")).collect()}
    want = {}
    for _, t in rows:
        for w in (t or "").encode().split():
            h = int(lm_score.Words([w]).hash.view(np.int64)[0])
            want[h] = want.get(h, 0) + 1
    assert counts == want


def test_lm_beats_the_unigrams_and_is_alike_however_the_table_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    sample = [(r.text or "").encode() for r in docs.where(held).collect()]
    w = lm_score.Words(sample)
    means = []
    for parts in (4, 32):
        model = lm_score.fitted(docs.where(~held).repartition(parts))
        v, log = model.vocabulary, model.log_probabilities(w)
        mass = np.bincount(v.of[:-1], v.count, minlength=v.classes)
        mass[-1] = v.total - v.count.sum()
        index = v.index(w.hash)
        # the same but for the class, which unigrams take by its mass
        unigram = log - log_class(model, w) + np.log(mass / mass.sum())[v.of[index]]
        assert log.mean() > unigram.mean() + 0.5
        means.append(np.bincount(w.doc, log, minlength=len(sample)) / np.maximum(w.n, 1))
    assert np.abs(means[0] - means[1]).mean() < 0.25  # of about 11


def log_class(model, w):
    v, p = model.vocabulary, lm_score.split(model.flat, model.vocabulary, model.shape)
    index = v.index(w.hash)
    return lm_score.class_logs(p, v, lm_score.forward(p, lm_score.contexts(index, w.n, v.size + 1))[1], v.of[index])


def test_gradient_step_lowers_the_loss():
    v = lm_score.Vocabulary(np.arange(7, dtype=np.uint64), np.ones(7), 7, of=np.r_[np.arange(7) % 4, 4], classes=5)
    shape = lm_score.Shape(embedding=3, hidden=5)
    p = lm_score.split(lm_score.start(v, shape), v, shape)
    ids = np.arange(400) % 7
    context, target = lm_score.contexts(ids, np.array([400]), 8), ids % 4
    loss = lambda: -np.mean(lm_score.class_logs(p, v, lm_score.forward(p, context)[1], target))
    before, squares = loss(), {k: np.zeros_like(x) for k, x in p.items()}
    for _ in range(60):
        lm_score.step(p, v, squares, context, target, 0.1)
    assert loss() < 0.2 * before


def test_chat_collapse(spark):
    rows = [(1, 1, "u", "hi"), (2, 1, "u", "hi"), (2, 2, "a", "yo"), (3, 1, "u", "hi"), (3, 2, "a", "yo"), (4, 1, "u", "hi"), (4, 2, "a", "no"), (5, 1, None, None), (None, 1, "u", "h"), (6, 2, "a", "z"), (6, None, "u", "y"), (6, None, "u", "y")]
    chats = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, hash int")
    got = {r.conv_id: r for r in chat.formatted(chats).collect()}
    assert set(got) == {2, 4, 5, 6, None} and got[2].n_copies == 2
    assert got[6].chat == "<|u|>\ny<|end|>\n<|u|>\ny<|end|>\n<|a|>\nz<|end|>\n" and got[5].chat == "<||>\n<|end|>\n"
    assert chat.formatted(chats.limit(0)).count() == 0


def test_prefixes_of_chats(spark):
    rows = [(1, 1, "hi"), (2, 1, "hi"), (2, 2, "yo"), (3, 1, "hi"), (3, 2, "yo"), (3, 3, "so"), (4, 1, "hi"), (4, 2, "no"), (5, 1, "hi"), (5, 2, "no"), (6, 1, "x")]
    chats = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.within) for r in chat.prefixes(chats).collect()} == {(1, 3), (2, 3), (5, 4)}
    assert {r.conv_id for r in chat.formatted(chats).collect()} == {3, 4, 6} and chat.prefixes(chats.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    turns = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = chat.formatted(turns.repartition(5)).collect()
    assert len(got) == 1 and got[0].n_turns == 20_000 and got[0].chat.startswith("<|u|>\nt0<|end|>\n<|u|>\nt1<|end|>")


def test_shared_folder_or_an_error(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder, self._jsc = master, folder, spark.sparkContext._jsc

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.folder

    class Session:
        def __init__(self, context, **conf):
            self.sparkContext, self.conf, self._jvm = context, Conf(**conf), spark._jvm

    with pytest.raises(RuntimeError, match="share"):
        common.shared_dir(Session(Context("spark://host:7077")))
    # a path without a scheme is where Spark's default file system has it
    assert common.shared_dir(Session(Context("spark://host:7077"), **{"spark.checkpoint.dir": "/shared/x/"})) == "file:/shared/x"
    assert common.shared_dir(Session(Context("yarn", "/kept"))) == "file:/kept"


def test_classifier_scores_odd_texts(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(90)]
    bad = [" ".join(rng.choice(["buy", "now", "$$$", "click"]) for _ in range(60)) for _ in range(90)]
    texts = [*good, *bad, None, "", "x", good[0] * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 90)) for k in range(180)] + [(0, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classifier.scored(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    # contradicted labels teach nothing: as if the row had none
    without = {r.doc_id: r.score for r in classifier.scored(docs, labels.where("doc_id <> 0")).collect()}
    assert all(got[k].score == pytest.approx(v) for k, v in without.items())
    assert sum(got[k].score > 0.5 for k in range(90)) > 80 > sum(got[k].score > 0.5 for k in range(90, 180)) + 60
    # of the fitted curve, by hand
    model = classifier.trained(docs, labels)
    two = [len(c.compress(good[3].encode())) for c in classifier.compressors(model)]
    n = len(good[3].encode()) + 1
    x = [(two[0] - two[1]) / sum(two), two[1] / n, min(two[1] / n, 0.3), np.log(n)]
    z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
    assert got[3].score == pytest.approx(1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("seed", range(3))
def test_encoders_on_odd_texts(seed):
    rng = random.Random(seed)
    parts = list("abstmrvlÀé'  \n\t..!,19²Ⅷ½") + ["'s", "'re", "''", " 've", "'she", "́", "\x1c", "\x85", "\xa0", "ß", "İ", "ſ", "中", "😀", "​", "　", "ΑΣ", "<|", "|>", "don't", " mill, ", "\u0000", "<|endoftext|>", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(300)]
    for name, made in ((queries.WORD_BPE, word_bpe.WordBpe), (queries.BYTE_BPE, token_files.Encoder)):
        path = public_tokenizers.path(name)
        lib, own = Tokenizer.from_file(path), made(path)
        for _ in range(2):  # the second time from what was kept
            assert [x.tolist() for x in own.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_forgets_and_stays_right():
    rng = np.random.default_rng(4)
    store, told = strings.Store(np.dtype(np.uint16), 500), lambda h: np.arange(int(h) % 4, dtype=np.int64) + int(h) % 1000
    for _ in range(40):
        one = np.unique(rng.integers(0, 3000, 200, dtype=np.uint64))

        def learn(fresh, one=one):
            runs = [told(h) for h in one[fresh]]
            return np.concatenate(runs), np.array([len(r) for r in runs])

        flat, at, size = store.runs(one, one * np.uint64(3), learn)
        assert [flat[a : a + n].tolist() for a, n in zip(at, size, strict=True)] == [told(h).tolist() for h in one]
        assert len(store) <= 700


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    c = sorted(want.columns)
    assert c == sorted(got.columns)
    assert sorted(map(tuple, got[c].astype(str).to_numpy())) == sorted(map(tuple, want[c].astype(str).to_numpy()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = staged.count()
        staged = stage(spark, staged, SF)
        assert staged.columns == docs.columns and 0 < staged.count() <= before
    assert set(out.doc_id) == {r.doc_id for r in staged.select("doc_id").collect()}
