"""Search over vectors, and extraction from pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.llm import ann, graph, html_extract
from tissuelake.llm.graph import components

VECTORS = "vec_id long, embedding array<double>, label int, rank string, code string, vec string, t string"


def odd(rows):
    return [(i, v, 0, "clash", "clash", "clash", "clash") for i, v in rows]


def test_search_against_brute_force(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = frame.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in ann.search(frame).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = ann.cosines(x[k], x)
        s[k] = -9
        best = np.lexsort((ids, -s))[:5]
        own = found[int(ids[k])]
        assert sorted(own) == [1, 2, 3, 4, 5]
        order = [(-own[i][1], own[i][0]) for i in range(1, 6)]
        assert order == sorted(order)
        for v, score in own.values():
            assert score == s[np.flatnonzero(ids == v)[0]]
        hits += len({v for v, _ in own.values()} & set(ids[best].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_finer_buckets_find_near_vectors(spark):
    draw = np.random.default_rng(21)
    centres = draw.normal(size=(60, 32))
    x = centres[draw.integers(0, 60, 1500)] + 0.35 * draw.normal(size=(1500, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    hits = 0
    found = ann.search(frame, axes=2, n_probes=64).collect()
    for q in range(0, 1500, 50):
        s = ann.cosines(x[q], x)
        s[q] = -9
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(found) == 150 and hits / 150 >= 0.9


def test_search_of_very_long_vectors(spark):
    draw = np.random.default_rng(22)
    x = draw.normal(size=(12, 3000))
    frame = spark.createDataFrame([(i * 25, (v * 1e200).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = [r for r in ann.search(frame).collect() if r.query_id == 0]
    s = ann.cosines(x[0], x)
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"])] == [25 * int(k) for k in np.argsort(-s)[1:6]]


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = odd([(0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (8, []), (1, [2.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0])])
    found = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (0, 4, 9, -1.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0), (50, 4, 9, -1.0)]
    assert ann.search(spark.createDataFrame([], VECTORS)).collect() == []


def test_rotations_keep_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(20, 16))
    y = ann.rotated(x, 3, 1)
    assert np.allclose(x @ x.T, y @ y.T)


def test_codes_are_the_first_probes():
    x = ann._unit(np.random.default_rng(1).normal(size=(50, 16)))
    for axes in (1, 2):
        assert (ann.probes(x, 0, axes, 4)[:, 0] == ann.codes(x, 0, axes)).all()


@pytest.mark.parametrize(("hub", "hub_links"), [(False, 1000), (False, 2), (True, 1000), (True, 2)])
def test_components(spark, hub, hub_links, monkeypatch):
    monkeypatch.setattr(graph, "HUB_LINKS", hub_links)
    draw = np.random.default_rng(2)
    links = [(0, i) for i in range(1, 400)] if hub else [(i, i + 1) for i in range(100) if i % 17] + [tuple(sorted(x)) for x in draw.integers(200, 400, (150, 2)).tolist()]
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert found == {x: root(x) for x in up if root(x) != x}


@pytest.mark.parametrize(("least_hub", "hubs"), [(0, 200_000), (3, 200_000), (3, 1), (1000, 200_000)])
def test_least_neighbours_of_hubs(spark, least_hub, hubs, monkeypatch):
    monkeypatch.setattr(graph, "HUB_LINKS", least_hub)
    monkeypatch.setattr(graph, "HUBS", hubs)
    links = [(1, b) for b in range(2, 60)] + [(2, 5), (2, 4), (3, 9), (3, 9), (4, 7), (4, 3), (4, 8), (4, 6)]
    found = graph._beside_least(spark.createDataFrame(links, "a long, b long"), len(links), F.min("b"))
    assert sorted(map(tuple, found.select("a", "b", "m").collect())) == sorted((a, b, min(y for x, y in links if x == a)) for a, b in links)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<aside>Side</aside>{body}<div class="ad">Buy</div><section id="comments"><article class="comment"><p>First!</p></article></section>
<form><label>Mail</label><input></form><footer>&copy; host</footer></body></html>"""
ARTICLE = "<article><h1>Title &amp; more</h1><p>One  <b>bold<br>line</p><p>Two&nbsp;words<p>Three <a href='x>y'>link</a>.<ul><li>a<li>b</ul><pre>x\n  y</pre><aside>no</aside></article>"
TEXT = "Title & more\nOne bold line\nTwo words\nThree link.\na\nb\nx y"


def test_extract(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(body=ARTICLE.replace("Title", f"Title{i}"))) for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", PAGE.format(body=f"<div id='content'><h2>Head {i}</h2><p>Body of page {i} with words.</p></div><div id='x'>Fixed line</div>")) for i in range(8)]
    rows += [(40, None, None), (41, "", ""), (42, "not a url", "plain <b>text"), (43, "http://c.example/", PAGE.format(body=ARTICLE)), (43, "http://c.example/", PAGE.format(body=ARTICLE)), (44, "http://c.example/", "<article><p>" + "long " * 50_000 + "</article>"), (45, "http://c.example/", "<p>un<closed")]
    found = {}
    for r in html_extract.extract(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, tokens string")).collect():
        found.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    for i in range(8):
        assert found[i] == [(f"https://a.example/{i}", TEXT.replace("Title", f"Title{i}"), len(TEXT) + 1)]
        assert found[20 + i][0][1] == f"Head {i}\nBody of page {i} with words."
    assert found[40] == [(None, "", 0)] and found[41] == [("", "", 0)] and found[42] == [("not a url", "plain text", 10)]
    assert found[43] == [("http://c.example/", TEXT, len(TEXT))] * 2
    assert found[44][0][2] == 50_000 * 5 - 1
    assert found[45][0][1].startswith("un")


def direct_classes(rows):
    """Tokens of valid classes by definition: whole occurrence vectors, and different pages that have them."""
    from collections import defaultdict

    out = defaultdict(set)
    for host in {h for _, h, _ in rows}:
        own = [(html, html_extract.page_tokens(html)) for _, h, html in rows if h == host]
        classes = defaultdict(list)
        for token in {t for _, c in own for t in c}:
            classes[tuple(c[token] for _, c in own)].append(token)
        for vector, tokens in classes.items():
            if len(tokens) >= 3 and len({html for (html, _), n in zip(own, vector, strict=True) if n}) >= 3:
                out[host] |= set(tokens)
    return dict(out)


def test_templates_are_the_valid_classes(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select(F.col("page_id").alias("page"), html_extract.host_of(F.col("url")).alias("host"), "html")
    for frame in (pages, pages.unionAll(pages).repartition(5)):  # rows that repeat change nothing
        rows = [tuple(r) for r in frame.collect()]
        found = {r.host: r.tokens for r in html_extract.templates(frame).collect()}
        assert all(t == sorted(t) for t in found.values())
        assert {h: set(t) for h, t in found.items()} == direct_classes(rows)


def test_layouts_of_one_host_have_their_own_templates(spark):
    body = "<div class='l{k}'><div class='b'>Banner {k}</div><div class='m'>More of layout {k}</div><div class='t'><h2>Head {i}</h2><p>Words of page {i} only.</p></div></div>"
    rows = [(i, "http://h.example/", f"<html><body>{body.format(k=i % 5, i=i)}</body></html>") for i in range(40)]
    rows += [(100 + i, "http://h.example/", "<html><body><div class='t'><p>One text. </p><p>Copied often.</p></div></body></html>") for i in range(9)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert found[i] == f"Head {i}\nWords of page {i} only."
    assert all(found[100 + i] == "One text.\nCopied often." for i in range(9))  # copies of a page are one page


def test_extract_by_join_equals_broadcast(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = sorted(html_extract.extract(pages).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(html_extract.extract(pages).collect()) == want


def test_extract_empty(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_templates_are_of_ordered_and_nested_classes(spark):
    # The three notes (on every other page) stand in two gaps of the page's own class; the moved line changes its place.
    def page(i):
        notes = ("<i>n1</i><i class='x'>n2</i>", "<b>n3</b>") if i % 2 else ("", "")
        moved = "<u>moved</u>"
        first, last = (moved, "") if i % 4 < 2 else ("", moved)
        return f"<div><h1>a</h1>{first}{notes[0]}<h2>b</h2>{notes[1]}<h3>c</h3>{last}<p>own {i}</p></div>"

    rows = [(i, "h", page(i)) for i in range(12)]
    found = spark.createDataFrame(rows, "page long, host string, html string")
    tokens = set(html_extract.templates(found).first()["tokens"])
    of = lambda path, text: {html_extract.element_token(path), html_extract._hash("t", path, text)}
    assert tokens >= of("/div/h1", "a") | of("/div/h2", "b") | of("/div/h3", "c")
    assert tokens >= of("/div/i", "n1") | of("/div/i.x", "n2")  # four tokens in one gap
    assert not tokens & (of("/div/b", "n3") | of("/div/u", "moved"))  # two in another gap; two out of order


def test_invalid_tokens():
    page = lambda s: [(ord(c), "ABCabc".index(c) // 3, "ABCabc".index(c) % 3) for c in s]
    letters = lambda found: tuple("".join(sorted(map(chr, x))) for x in found)
    check = lambda s: letters(html_extract.invalid_tokens(page(s), {0: 3, 1: 3}))
    for valid in ("ABC", "ABCabc", "AabcBC", "ABCABC", "ABabcCAabcBC", "AabcabcBC", ""):
        assert check(valid) == ("", "")
    assert check("AaBbcC") == ("", "b") and check("AaBbCc") == ("", "bc")
    assert check("BCA") == ("A", "") and check("AABBCC")[0]
