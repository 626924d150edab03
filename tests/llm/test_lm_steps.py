"""The network's steps and the words' hashes against plain ones, and what they cost."""

from __future__ import annotations

import time

import numpy as np

from archivolt.llm import lm_score, strings

SHAPE = lm_score.Shape()


def vocabulary(size=180_000, classes=107):
    rng = np.random.default_rng(3)
    v = lm_score.Vocabulary(np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64)), rng.integers(1, 99, size).astype(float), 10**8, classes=classes)
    v.of = np.append(rng.integers(0, classes - 1, size), classes - 1)
    return v


def batches(v, n, rows=2048):
    """Contexts and targets, a twentieth of them rare words, the frequent ones more often."""
    rng = np.random.default_rng(5)
    for _ in range(n):
        ids = np.where(rng.random((rows, 5)) < 0.05, v.size, (v.size * rng.random((rows, 5)) ** 4).astype(np.int64))
        yield ids[:, :4], v.of[ids[:, 4]]


def softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def plain_step(p, v, squares, context, target, rate):
    """The same step a group of rows at a time, its embeddings by ``add.reduceat``."""
    n, bounds = len(target), v.bounds
    group = np.searchsorted(bounds, target, side="right") - 1
    order = np.argsort(group, kind="stable")
    context, target, group = context[order], target[order], group[order]
    begins = np.searchsorted(group, np.arange(len(bounds)))
    x = p["e"][context].reshape(n, -1)
    h = np.tanh(x @ p["w"] + p["b"])
    g = softmax(h @ p["u"] + p["c"])
    g[np.arange(n), group] -= 1
    g /= n
    into_hidden, deeper, base = g @ p["u"].T, np.zeros_like(p["v"]), np.zeros_like(p["d"])
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        at = slice(begins[k], begins[k + 1])
        if begins[k] < begins[k + 1] and b - a > 1:
            q = softmax(h[at] @ p["v"][:, a:b] + p["d"][a:b])
            q[np.arange(len(q)), target[at] - a] -= 1
            q /= n
            into_hidden[at] += q @ p["v"][:, a:b].T
            deeper[:, a:b], base[a:b] = h[at].T @ q, q.sum(axis=0)
    back = into_hidden * (1 - h * h)
    into = (back @ p["w"].T).reshape(4 * n, -1)
    flat = context.ravel().astype(np.int32)
    by_word = np.argsort(flat)
    words = flat[by_word]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    words, deep = words[first], np.add.reduceat(into[by_word], first, axis=0)
    squares["e"][words] += deep * deep
    p["e"][words] -= rate * deep / np.sqrt(squares["e"][words] + 1e-8)
    for k, grad in (("w", x.T @ back), ("b", back.sum(axis=0)), ("u", h.T @ g), ("c", g.sum(axis=0)), ("v", deeper), ("d", base)):
        squares[k] += grad * grad
        p[k] -= rate * grad / np.sqrt(squares[k] + 1e-8)


def run(step, v, given):
    flat = lm_score.start(v, SHAPE)
    p = lm_score.split(flat, v, SHAPE)
    squares, took = {k: np.zeros_like(x) for k, x in p.items()}, []
    for context, target in given:
        began = time.thread_time()
        step(p, v, squares, context, target, 0.05)
        took.append(time.thread_time() - began)
    return flat, float(np.median(took))


def test_steps_are_those_of_a_plain_one_at_less_cost():
    v = vocabulary()
    given = list(batches(v, 40))
    (want, before), (got, now) = run(plain_step, v, given), run(lm_score.step, v, given)
    assert np.abs(want - lm_score.start(v, SHAPE)).max() > 0.1
    assert np.allclose(got, want, atol=1e-4)
    assert now < 0.75 * before


def test_hashes_are_plain_sums_also_beyond_a_block(monkeypatch):
    mask = (1 << 64) - 1

    def plain(codes):
        one = two = 0
        for place, c in enumerate(codes):
            x = ((place << 21 | c) + int(strings.M3)) * int(strings.M1) & mask
            x = (x ^ x >> 30) * int(strings.M2) & mask
            x ^= x >> 27
            y = x * int(strings.M3) & mask
            y = (y ^ y >> 31) * int(strings.M1) & mask
            one, two = one + x & mask, two + (y ^ y >> 29) & mask
        return one, two

    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 21, 700).astype(np.uint32)
    cuts = np.r_[3, np.unique(rng.integers(4, 500, 90)), 699]
    keep = rng.random(len(cuts) - 1) < 0.7
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    want = [plain(codes[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
    for block in (1, 16, 1 << 15):
        monkeypatch.setattr(strings, "BLOCK", block)
        one, two = strings.hashes(codes, starts, ends)
        assert list(zip(one.tolist(), two.tolist(), strict=True)) == want
        one, two = strings.hashes(codes, starts, ends, both=False)
        assert one.tolist() == [x for x, _ in want] and not len(two)


def test_passes_that_need_one_hash_make_no_second():
    (_, _, w), = lm_score.flats([b"a bc\x0bd", b"", b"\ta bc "])
    assert len(w.hash) == 5 and not len(w.second) and w.n.tolist() == [3, 0, 2]
    (_, _, both), = lm_score.flats([b"a bc\x0bd", b"", b"\ta bc "], both=True)
    assert (both.hash == w.hash).all() and len(both.second) == 5


def test_places_of_words_in_any_order():
    v = vocabulary(1000)
    asked = np.r_[v.words[::-1], v.words[5:9], np.array([1, 2], np.uint64)]
    assert v.index(asked).tolist() == [*range(999, -1, -1), 5, 6, 7, 8, 1000, 1000]
    assert v.index(asked[:0]).tolist() == []
