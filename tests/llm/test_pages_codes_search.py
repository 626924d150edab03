"""Main text of pages, vector codes and ranked search against plain versions, on small
tables with nulls, empty and long values, ties, repeated rows and clashing columns."""

import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pytest

from archivolt.llm import html_text, lexical, queries, vector_codes

SF = "/root/testdata/sf0.001"
SAID = "One sentence of an article, that says what such sentences say, and then some more. "


# --- pages

def cut_out(page):
    """What the given pages declare as their article."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    got = queries.op11_html_extraction(spark, SF).collect()
    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(given)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, cut_out(given[r.page_id].html), len(r.text))


def test_given_pages_without_their_names(spark):
    """The same pages with all telling names replaced: density alone must find the text."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    plain = [re.sub(r"</?(?:nav|article|footer)>", lambda m: m[0].replace(m[0].strip("</>"), "div"), p.replace(' class="ad"', "")) for p in pages]
    kept = lost = strange = 0
    for page, bare in zip(pages, plain, strict=True):
        want, got = cut_out(page).split("\n"), html_text.main_text(bare).split("\n")
        kept += sum(len(x) for x in want if x in got)
        lost += sum(len(x) for x in want if x not in got)
        strange += sum(len(x) for x in got if x not in want)
    assert lost < 0.02 * kept and strange < 0.05 * kept


FRAMES = {
    "semantic": "<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>Head</h1>{}</main><aside><p>{}</p></aside><footer>(c)</footer>",
    "named": "<div id='top-menu'><a href=x>Home</a></div><div class='main-content with-sidebar'><h2>Head</h2>{}</div><div class='sidebar left'><p>{}</p></div><div class='cookieNotice'>We use cookies</div>",
    "comments": "<article><header><h1>Head</h1></header>{}<aside>Quoted</aside><footer>tags</footer></article><section id=comments><article class=comment><p>{}</p></article></section>",
    "nested": "<article><h1>Head</h1>{}<article><p>{}</p></article></article>",
    "form": "<form id=f><div><h1>Head</h1>{}</div><label>Mail</label><input name=a><select><option>x<option>y</select><div class=promo>{}</div></form>",
    "related": "<main><h1>Head</h1>{}</main><section class=related-posts><article><h3><a href=u>Card</a></h3>{}</article></section>",
    "roles": "<div role=banner>Shop</div><div><h1>Head</h1>{}</div><div role=complementary>{}</div><div style='display: none'>gone</div><div hidden>gone</div>",
    "forms": "<div><h1>Head</h1>{}</div><form action=x><p>{}</p><textarea>y</textarea><button>Send</button></form><noscript>none</noscript><!-- <p>c</p> --><style>p{{}}</style><script>'</p>'</script>",
}


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_frames(name):
    body = f"<p>{SAID * 3}<p>{SAID}</p><p>Short.</p><ul><li>a <b>b</b><li>c</ul>"
    want = ["Head", (SAID * 3).strip(), SAID.strip(), "Short.", "a b", "c"]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{FRAMES[name].format(body, SAID * 2)}"
    assert html_text.main_text(page).split("\n") == want


def test_parts_beside_each_other():
    page = f"<div><div><p>{SAID * 2}</p><p>{SAID * 3}</p></div><div><p>{SAID * 4}</p><p>{SAID * 2}</p></div><div><a href=1>x</a> <a href=2>y</a></div></div>"
    assert html_text.main_text(page).split("\n") == [(SAID * k).strip() for k in (2, 3, 4, 2)]


def test_markup():
    read = html_text.main_text
    assert read("") == read("<p></p>") == read("<script>x") == read("<!-- x") == ""
    assert read("plain &amp; <i>old</i>\n text") == "plain & old text"
    assert read(f"<p title=\"5\" tall\">x</p><p data-a='a>b'>{SAID}</p><p>a < b > c&nbsp; &lt;t&gt; &#x41; &notin; &am</p><a href=\"x") == f"x\n{SAID.strip()}\na < b > c <t> A ∉ &am"
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert read("<p>a</i></div></b>b</p>") == "ab" and read("<p>a<br>b<br/>c") == "a b c"


@pytest.mark.parametrize("piece", ["<a", "<div>", '<a "', '<p x="', "<b></i>", "<p>x", "<script>", "<table><tr><td>", "<ul><li>", "<!--", "&", "<", "<a>x<b>"])
def test_long_broken_pages_are_linear(piece):
    began = time.process_time()
    html_text.main_text(piece * 20_000)
    assert time.process_time() - began < 10


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{SAID}</p></article>", 5), (1, "u", f"<article><p>{SAID}</p></article>", 5), (None, None, None, 1), (2, "v", "", 1), (3, "w", "<p>" + "x" * 300_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in html_text.extracted(df).collect()), key=str)
    assert got == sorted([(1, "u", len(SAID) - 1, len(SAID) - 1)] * 2 + [(0, None, 0, 0), (2, "v", 0, 0), (3, "w", 300_000, 300_000)], key=str)
    assert html_text.extracted(df.limit(0)).count() == 0


# --- codes

def plain_codes(rows, parts=4, entries=256, rounds=4):
    """op12's contract with Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    step = len(kept[0][1]) // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(r[1])[p] for r in by_id[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    find = lambda v: [min((far(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        found = [find(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [cut(r[1])[p] for r, f in zip(kept, found, strict=True) if f[p][1] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for (i, v, label) in kept for f in [find(v)]]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes(spark, entries):
    rng = random.Random(2)
    vector = lambda: [rng.choice([-0.3, 0.1, 0.25]) + rng.gauss(0, 0.02) for _ in range(8)]
    rows = [(k, vector(), rng.choice([0, 1, None])) for k in range(60)]
    rows += [rows[3], rows[3], (3, rows[3][1], 1), (None, vector(), 2), (99, [0.5] * 8, 1), (98, [0.5] * 8, 1), (200, [2.0**17 - 1] + [-(2.0**17) + 1] * 7, 3)]
    bad = [(70, None, 0), (71, [None, *vector()[1:]], 0), (72, [float("nan"), *vector()[1:]], 0), (73, [float("-inf"), *vector()[1:]], 0), (74, [], 1)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, entry int, code string").repartition(3)
    got = vector_codes.compressed(df, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, entries=entries)
    assert vector_codes.compressed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(df, parts=3)


def test_codes_leave_out_other_lengths(spark):
    df = spark.createDataFrame([(1, [0.0] * 4, 0), (2, [1.0] * 8, 0), (3, [1.0] * 4, 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.vec_id for r in vector_codes.compressed(df).collect()) == [1, 3]


# --- search

def plain_search(docs, items, k=10):
    """op13's contract, document by document."""
    words = lambda t: [w.translate(str.maketrans(lexical.UPPER, lexical.LOWER)) for w in re.findall(lexical.TERM, t or "")]
    held = [(i, w) for i, t in docs if (w := words(t))]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, w in held:
            m = 100 - 75 + (75 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in words(text) if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)] + ["ÉTÉ", "naïve", "X1y2", "λόγος"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for k in range(700)]
    docs += [(5, docs[5][1]), docs[6], docs[6], (None, docs[7][1]), (None, None), (800, ""), (801, " - "), (802, "w0 " * 30_000 + "naïve"), *((900 + k, "w3 w4 copy of one text") for k in range(300))]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for k in range(30)]
    items += [items[0], (0, "w3 w3 w4 copy"), (31, "W3,w4;x1Y2"), (32, None), (33, ""), (34, "nowhere found"), (35, "w0"), (None, "été λόγος text")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1, 5_000, 16 << 20])
def test_search(spark, library, monkeypatch, shard_bytes):
    docs, items = library
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "STRIDE", 5)
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical, "AT_ONCE", 12)
    if shard_bytes == 1:
        docs = docs[::9]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, term int, score int").repartition(3)
    q = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, key int")
    counted = lexical.statistics(d)
    path = f"{lexical.materialise(lexical.index(d, counted), 'test-index')[1]}"
    got = lexical.search(spark.read.parquet(path), counted, q)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items)


def test_search_skips_blocks(monkeypatch):
    """Blocks that can't reach the threshold aren't decompressed, and results stay."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(lexical, "STRIDE", 8)
    shard = lexical.Shard()
    for k in range(6000):
        shard.add(k, b"common " * int(rng.integers(1, 3)) + (b"rare " * 5 if k in (100, 300) else b"") + f"w{k}".encode())
    rows = [r for b in shard.rows(0, 6000, 12_000) for r in b.to_pylist()]
    head = next(r for r in rows if r["is_docs"])
    lists = lexical.Lists(head["data"], head["df"], 6000, 12_000)
    at = {r["term"]: lists.add(r["first"], r["last"], r["most"], r["ends"], r["data"]) for r in rows if r["term"] in (b"common", b"rare")}
    found = lists.best([(at[b"common"], 1), (at[b"rare"], 9000)], 1, 2)
    assert sorted(d for _, d in found) == [100, 300]
    assert len(lists.deep) < 10 < len(lists.last[at[b"common"]])


@pytest.mark.parametrize("seed", range(6))
def test_best_of_a_shard(monkeypatch, seed):
    """With small blocks and strides, many ties and any sound threshold to begin with."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "STRIDE", 3)
    rng = random.Random(seed)
    docs = [[f"t{min(int(rng.expovariate(0.4)), 9)}" for _ in range(rng.randrange(1, 7))] for _ in range(150)]
    n, total = len(docs), sum(map(len, docs))
    shard = lexical.Shard()
    for k, d in enumerate(docs):
        shard.add(k, " ".join(d).encode())
    rows = [r for b in shard.rows(0, n, total) for r in b.to_pylist()]
    head = next(r for r in rows if r["is_docs"])
    for _ in range(20):
        query = {f"t{t}": rng.choice([1, 3, 50]) for t in rng.sample(range(10), rng.randrange(1, 6))}
        score = lambda d: sum(w * (1_000_000_000 * d.count(t) // (1000 * d.count(t) + 8 * (25 + 75 * len(d) * n // total))) for t, w in query.items() if t in d)  # noqa: B023, E731
        want = sorted(((score(d), k) for k, d in enumerate(docs) if score(d)), key=lambda x: (-x[0], x[1]))[:5]
        lists = lexical.Lists(head["data"], head["df"], n, total)
        weights = [(lists.add(r["first"], r["last"], r["most"], r["ends"], r["data"]), query[r["term"].decode()]) for r in rows if r["term"].decode(errors="replace") in query]
        for need in (1, want[-1][0] if len(want) == 5 else 1):
            assert lists.best(weights, need, 5) == want


def test_packed_values():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**31 - 1, 5])
    raw, ends = lexical.packed(values)
    assert lexical.unpacked(raw).tolist() == values.tolist() and ends[-1] == len(raw) and lexical.unpacked(raw[:3]).tolist() == [0, 1, 127]


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(d, q).count() == 0
    assert lexical.ranked(q.selectExpr("item_id AS doc_id", "text"), q.limit(0)).count() == 0
