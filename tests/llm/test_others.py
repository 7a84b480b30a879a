"""Vectors, pages, conversations, and the pipeline as a whole."""

import collections
import json
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cases
from cloneforge.llm import ann, html, quotes, registry

# --- nearest neighbours


def exact(ids, x, every, top):
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[int(q)] = ids[order].tolist()
    return out


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = ann.search(df, reranked=120).toPandas()  # of a few rows by four bits, a fifth
    want = exact(np.arange(600), x, 20, 20)
    assert set(got.query_id) == set(want)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.95
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, x[g.vec_id] @ x[q]) and (np.diff(g.score) <= 1e-15).all()


def test_recall_of_a_short_list_over_blocks(spark, monkeypatch):
    # no row has near ones, which is the hardest; 1.7 % of the rows are reranked
    monkeypatch.setattr(ann, "ROWS", 5000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(30_000), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = ann.search(df, every=300).toPandas()
    want = exact(np.arange(30_000), x, 300, 20)
    recall = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) / (20 * len(want))
    assert set(got.query_id) == set(want) and recall >= 0.9


def test_ann_finds_what_is_near_where_codes_tell_rows_apart_badly(spark):
    """Rows in a few tight crowds have equal codes, and a few rows are longer than any that codebooks were fitted on."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3, 64))[rng.integers(0, 3, 6_000)] + rng.normal(0, 1e-3, (6_000, 64))
    x[::500] *= rng.uniform(5, 9, (12, 1))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, every=200).toPandas()
    assert len(got) == 30 * 20
    for q, own in got.groupby("query_id"):
        far = (x * x[q]).sum(1)
        far[q] = -np.inf
        assert own.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(len(x)), -far))[:20].tolist()


def test_codewords_solve_the_normal_equations():
    rng = np.random.default_rng(8)
    n, m = 200, 3
    x, code = rng.normal(size=(n, 2 * m)), rng.integers(0, 16, (n, m))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    place = ((np.arange(m)[None] * 16 + code)[:, :, None] * 2 + np.arange(2)).reshape(n, -1)
    z, u = np.zeros((n, 96)), np.zeros((n, 96))
    np.put_along_axis(z, place, unit, 1)
    np.put_along_axis(u, place, 1.0, 1)
    a = np.diag(u.sum(0) + 1e-6) + 4.0 * z.T @ z
    b = (u * 0).sum(0) + np.bincount(place.ravel(), x.ravel(), minlength=96) + 4.0 * z.T @ np.linalg.norm(x, axis=1)
    assert np.allclose(ann._solved(place, x, unit, np.zeros(96), 5.0, 400), np.linalg.solve(a, b), atol=1e-5)


def test_search_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "ROWS_LEAST", 10)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    x[x.any(1) == 0] = 1
    x[60:] = x[0]  # one vector has most rows
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, every=10, top=7).toPandas()
    want = exact(np.arange(150), x, 10, 7)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")} == want


def test_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0]), (7, [9.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score", "2 as key", "3 as rank")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).collect()}
    assert got == {(0, 1, 7, 9.0), (0, 2, 20, 4.0), (20, 1, 7, 9.0), (20, 2, 0, 4.0)}
    assert ann.search(df.limit(0)).count() == 0


def test_loss_along_the_vector_is_less():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 64))
    books = ann.Codebooks.fit(x)
    plain = ann.Codebooks(64, books.words, 1.0)
    along = lambda b: np.mean(((x - decoded(b, x)) * x).sum(1) ** 2 / (x * x).sum(1))
    assert books.eta > 1 and along(books) < along(plain)


def decoded(books, x):
    code = books.encode(x)
    return books.words[np.arange(code.shape[1])[None], code].reshape(len(x), -1)


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header class="top">Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">Cookies!</div><div class="wrap"><div class="{main}"><h1>{title}</h1><p>{a} &amp; <b>bold</b><br>line</p><p>{b}<div class="share-box">Share</div></div><aside>Side</aside></div>
<section class="comments"><article>Reader says</article></section><form>Name</form><footer>&copy; me</footer></body></html>"""


def test_fields_and_article():
    page = PAGE.format(main="content", title="Head", a="x", b="y &#233;")
    assert html.main_text(page, None) == "Head\nx & bold line\ny é"
    assert html.main_text("<article><header><h1>H</h1></header><p>a<p>b <nav>n</nav></article>rest", None) == "H\na\nb"
    assert html.main_text("<body><main><p>a\n  b</p>\xa0<ul><li>c<li>d</ul></main><p>out</p></body>", None) == "a b\nc\nd"
    assert html.main_text("<p>1 < 2 &lt; 3<!-- no --><p>z", None) == "1 < 2 < 3\nz"
    assert html.main_text("", None) == "" and html.main_text("plain", None) == "plain"
    assert html.main_text("<table><tr><td>a<td>b<tr><td>c</table>", None) == "a b\nc"
    assert html.main_text("<article>in<script>x", None) == "in"


def test_wrapper_finds_the_region(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(main="q7", title=f"Title {k}", a=f"text {k} " * 20, b=f"more {k} " * 30).replace('<div class="wrap">', '<div class="wrap"><div class="x1">Always here</div>')) for k in range(6)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(t.split("\n")[0] == f"Title {k}" and "Always" not in t and "Share" not in t and len(t.split("\n")) == 3 for k, t in got.items())


def texts(spark, pages):
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_wrapper_of_pages_that_name_their_article(spark):
    page = '<body><nav>{k} n</nav><article><div class="w-1/2"><p>Always here</p></div><ul><li>Home<li>About</ul><h1>Daily</h1><p>text {k}</p>{more}</article><div>x {k}</div></body>'
    got = texts(spark, [page.format(k=k, more=f"<section><h3>Note {k}</h3></section>" if k == 2 else "<blockquote><p>Twice</p></blockquote>" if k > 3 else "") for k in range(6)])
    assert got == {k: f"Daily\ntext {k}" + ("\nNote 2" if k == 2 else "\nTwice" if k > 3 else "") for k in range(6)}
    # copies alone tell nothing, and neither does one page
    assert set(texts(spark, [page.format(k=1, more="")] * 3).values()) == {"Always here\nHome\nAbout\nDaily\ntext 1"}
    # an article that all pages share stays, though what is around it differs
    assert set(texts(spark, [f"<article><p>same</p></article><div><p>{k}</p></div>" for k in range(3)]).values()) == {"same"}


def test_wrapper_of_many_paths_and_containers(spark, monkeypatch):
    # classes of their own on each page; the text is in two containers, and comes after the classes
    page = '<body>{own}<div class="top"><h1>Title {k}</h1></div><div class="q7"><p>text {k} and more</p></div><div class="z"><p>Always here</p></div></body>'
    pages = [page.format(k=k, own="".join(f'<div class="c{k}-{n}"><p>a {k} {n}</p></div>' for n in range(60))) for k in range(12)]
    own = lambda k: "".join(f"a {k} {n}\n" for n in range(60))
    want = {k: f"{own(k)}Title {k}\ntext {k} and more" for k in range(12)}
    assert texts(spark, pages) == want
    monkeypatch.setattr(html, "SALTS", 1)
    assert texts(spark, pages) == want and texts(spark, pages[::-1]) == {k: want[11 - k] for k in want}


def test_names_that_only_sound_like_boilerplate(spark):
    page = '<article><p>a</p><section class="social-history"><p>b</p></section><p>c <math>x</math> d</p><object><p>e</p></object><div class="related-posts-2">f</div><div class="ad-300x250">g</div></article>'
    assert texts(spark, [page]) == {0: "a\nb\nc x d\ne"}


def test_a_menu_whose_links_change(spark):
    page = '<body><div class="k1">{links}</div><div class="k2"><p>text {k} has a <a href="/">link</a></p><p>more {k}</p></div></body>'
    pages = [page.format(k=k, links="".join(f'<span><a href="/{k}{i}">go {k} {i}</a></span><br/><ul><li><a href="#">{i}{k}</a></li><li><a>{k}</a></li></ul>' for i in range(1))) for k in range(6)]
    got = texts(spark, pages)
    assert all("has a link" in t and f"more {k}" in t and f"0{k}" not in t for k, t in got.items())
    # one page alone tells no menu, and a list of links in an article stays
    assert texts(spark, ["<article><p>a {0}</p><ul><li><a>x{0}</a></li><li><a>y{0}</a></li></ul></article>".format(k) for k in range(3)]) == {k: f"a {k}\nx{k}\ny{k}" for k in range(3)}


def test_shapes_in_rounds(spark):
    """Many rows of one shape, gathered in rounds, say the same as all pages folded by one task; other shapes stay as they are."""
    rows = [(k, "http://a.example/x", f"<h1>t{k}</h1><p>same</p><ul><li>{k % 3}<li>b</ul>") for k in range(300)] + [(k, "http://b.example/x", f"<p>{k}</p>" + "<h2>x</h2><p>y</p>" * (k % 4)) for k in range(300, 340)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {(r.host, r.shape): (json.loads(r.wrapper), r.pages) for r in html.shaped(df.coalesce(1)).collect()}
    dealt = html.shaped(df.repartition(60)).persist()
    assert dealt.count() > 2 * len(want) == 10
    got = html.gathered(dealt, 1).collect()
    dealt.unpersist()
    assert len(got) == len(want)
    assert {(r.host, r.shape): (json.loads(r.wrapper), r.pages) for r in got} == want
    assert html.gathered(html.shaped(df.limit(0)), 1).count() == 0


def test_hosts_of_many_shapes(spark, monkeypatch):
    """With more salts than the least a page's text stays."""
    rows = [(k, "http://a.example/x", "<nav>menu</nav>" + "".join(f"<{'h2' if k >> j & 1 else 'p'}>own {k} {j}</{'h2' if k >> j & 1 else 'p'}><hr>" for j in range(7))) for k in range(128)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    monkeypatch.setattr(html, "GROUP", 300)
    got = {r.page_id: r.text for r in html.extracted(df).collect()}
    assert got == {k: "\n".join(f"own {k} {j}" for j in range(7)) for k in range(128)}


def test_wrappers_whatever_the_partitions(spark):
    # classes say nothing: what changes is the article, and a group that comes once, twice or not at all is part of it
    rng = random.Random(3)
    page = '<body><div class="k1"><span>Menu one</span></div><div class="k2"><h2>{title}</h2>{groups}<p>Written by the desk</p></div><div class="k3"><p>All rights reserved</p></div></body>'
    pages, want = [], {}
    for k in range(120):
        title, groups = cases.sentence(rng, 4), [cases.sentence(rng, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 4))]
        note = k % 3 == 0
        pages.append(page.format(title=title, groups="".join(f"<p>{g}</p>" for g in groups) + (f"<blockquote>{title} again</blockquote>" if note else "")))
        want[k] = "\n".join([title, *groups, *([f"{title} again"] if note else []), "Written by the desk"])
    df = spark.createDataFrame([(k, f"http://h{k % 2}.example/{k}", p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")
    one = {r.page_id: r.text for r in html.extracted(df.coalesce(1)).collect()}
    many = {r.page_id: r.text for r in html.extracted(df.repartition(50)).collect()}
    assert one == many == want


def test_wrapper_without_names(spark):
    """Adverts and footers that change from page to page go, and so does the menu, though no element has a name that says so; the result is that of the same pages with names."""
    rng = random.Random(8)
    page = '<html><body><nav><ul>{menu}</ul></nav><div class="ad">{ad}</div><article><h1>{title}</h1>{body}</article><footer>&copy; h &middot; {foot}</footer></body></html>'
    named, plain, want = [], [], {}
    for k in range(80):
        say = lambda n: cases.sentence(rng, n)
        title, blocks = say(5), [say(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))]
        loose = say(6) if k % 5 == 0 else ""
        html_ = page.format(menu="".join(f'<li><a href="/{w}">{w}</a></li>' for w in say(5).split()), ad=say(9), title=title, body="".join(f"<p>{b}</p>" for b in blocks) + loose, foot=say(6))
        named.append(html_)
        plain.append(re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", html_).replace(' class="ad"', ""))
        want[k] = "\n".join([title, *blocks, *([loose] if loose else [])])
    assert texts(spark, named) == want
    assert texts(spark, plain) == want
    # of copies and of a page alone nothing is told
    assert "\n" in texts(spark, plain[:1])[0] and len(texts(spark, plain[:1])[0]) > len(want[0])


def test_region(spark):
    def region(pages):
        got = html.regions(html.wrappers(spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id bigint, url string, html string"))).collect()
        return got[0].region if got else None

    body = "<p>some words of page {k}, and more</p>" * 5
    assert region([f"<div><div><h2>t {k}</h2><section>{body.format(k=k)}</section></div></div><div>ad {k}</div>" for k in range(4)]) == "/div/div"  # with its title
    assert region([f"<div><section>{body.format(k=k)}</section></div><h3>{k}</h3>" for k in range(4)]) is None  # the title is outside
    assert region([f"<div><section>{body.format(k=k)}</section></div><h3>always</h3>" for k in range(4)]) == "/div/section"
    assert region([f"<div>{body.format(k=k)}</div><section>{body.format(k=k + 9)}</section>" for k in range(4)]) is None  # neither has nearly all
    assert region([f"<div>{body.format(k=1)}</div>"] * 3) is None and region([f"<div>{body.format(k=1)}</div>"]) is None and region([]) is None
    assert region(["text", None, ""]) is None


def test_alignment():
    one = lambda *p: [[x, x, False, False, 1, 4, 0] for x in p]
    got = html.aligned(one("a", "b", "c"), one("a", "c", "d"))
    assert [(f[0], f[2]) for f in got] == [("a", False), ("b", True), ("c", False), ("d", True)]
    assert html.grouped(one("a", "b", "b", "c"))[1][3] is True
    assert html.aligned([["a", "x", False, False, 1, 5, 1]], [["a", "y", False, False, 2, 6, 2]]) == [["a", None, False, False, 3, 11, 3]]


def test_pages_odd(spark):
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    rows = [(1, None, None), (2, "http://a.example", ""), (2, "http://a.example", ""), (None, "x", "<p>t"), (3, "http://a.example/z", long), (4, "http://b.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'h' as host", "'w' as wrapper", "1 as n_chars", "'t' as text")
    got = html.extracted(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "" and by[2].n_chars == 0 and by[None].text == "t" and by[3].n_chars == 10 * 20000 - 1 and by[4].text == "deep"
    assert html.extracted(df.limit(0)).count() == 0


# --- conversations

CHAT = [
    (1, 0, "a", "The first message has a long line here.\n\nAnd a second paragraph of it."),
    (1, 1, "b", "An answer to the first one, written at once."),
    (1, 2, "c", "On Monday b wrote:\n> An answer to the first\n> one, written at once.\n>> The first message has a long line here.\nI disagree with that."),
    (1, 3, "d", "> And a second paragraph of it.\n\nThis part is what I mean."),
    (1, 4, "e", "No quote at all."),
    (1, 9, "f", "> not said by anyone before\nHm."),
    (2, 0, "a", "> And a second paragraph of it.\nElsewhere."),
]


def test_quotes(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")).collect()}
    short = {k: (r.reply_to, r.quoted, r.branch, r.position) for k, r in got.items()}
    assert short == {
        (1, 0): (None, False, 0, 0), (1, 1): (0, False, 0, 1), (1, 2): (1, True, 0, 2), (1, 3): (0, True, 1, 0), (1, 4): (3, False, 1, 1), (1, 9): (4, False, 1, 2), (2, 0): (None, False, 0, 0),
    }
    assert got[1, 2].text == "I disagree with that." and got[1, 2].n_quotes == 2 and got[1, 0].text == CHAT[0][3]
    assert [got[1, k].place for k in (0, 1, 2, 3, 4, 9)] == [0, 1, 2, 3, 4, 5]
    # what nobody said stays
    assert got[1, 9].text == CHAT[5][3] and got[2, 0].text == CHAT[6][3]


def conversation(rng, n):
    """Messages, and what is known of them: whom they answer, and what is left of them."""
    own, rows, truth = [], [], []
    for k in range(n):
        said = [f"own{k}p{p} " + cases.sentence(rng, rng.randrange(2, 12)) for p in range(rng.randrange(1, 4))]
        text, left, to = [], [], k - 1 if k else None
        kind = rng.randrange(5) if k else 0
        if kind in (1, 2, 3):
            to = rng.randrange(k)
            part = own[to] if kind == 1 else [rng.choice(own[to])]
            if rng.random() < 0.5:
                text += [f"On a day r{to} wrote:", ""]
            if kind == 3 and truth[to][0] is not None:
                text += [f">> {x}" for x in own[truth[to][0]]]
            for i, x in enumerate(part):
                w = x.split(" ")
                cut = rng.randrange(1, len(w) + 1)  # wrapped anew
                text += ([">"] if i else []) + ["> " + " ".join(w[:cut]).upper()] + (["> " + " ".join(w[cut:])] if cut < len(w) else [])
        elif kind == 4:
            left = [f">>> code{k} = {k}", f"> a proverb of {k}"]
            text += left
        text += ["", *"\n\n".join(said).split("\n")]
        left = "\n".join([*left, "", *"\n\n".join(said).split("\n")]).strip("\n") if kind != 0 and kind != 4 else "\n".join(text)
        rows.append("\n".join(text))
        own.append(said)
        truth.append((to, kind in (1, 2, 3), left))
    return rows, truth


def in_order(truth):
    """Each message, then what answers it: the next message first."""
    children = collections.defaultdict(list)
    for k, (to, _, _) in enumerate(truth):
        children[to].append(k)
    out, stack = [], [0]
    while stack:
        k = stack.pop()
        out.append(k)
        stack += children[k][::-1]
    return {k: i for i, k in enumerate(out)}


@pytest.mark.parametrize("stretch", [4096, 5])
def test_random_quotes(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rng = random.Random(6)
    chats = [conversation(rng, n) for n in (1, 2, 30, 60)]
    df = spark.createDataFrame([(c, k, "r", t) for c, (texts, _) in enumerate(chats) for k, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(df.repartition(3)).collect()}
    for c, (_, truth) in enumerate(chats):
        order = in_order(truth)
        for k, (to, quoted, left) in enumerate(truth):
            r = got[c, k]
            assert (r.reply_to, r.quoted, r.text, r.place) == (to, quoted, left, order[k])


def test_quotes_of_short_messages(spark):
    chat = ["Shall we begin?", "Yes.", "好的", "👍", "> Yes.\nThen let us.", "> 好的\nFine.", "> 👍\nSo do I.", "> not said\n> ---\nHm.", "> No.\nWho says that?"]
    rows = [(1, k, "r", t) for k, t in enumerate([*chat, "a\n---\nb", "> Shall we begin?\n> yes\nAgain."])]
    got = {r.turn: (r.reply_to, r.quoted) for r in quotes.linked(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[k] for k in range(4, 11)] == [(1, True), (2, True), (3, True), (6, False), (7, False), (8, False), (0, True)]


def test_quotes_over_stretches(spark, monkeypatch):
    rows = [(7, 2 * k, "r", f"message number {k} says this" if k % 5 else f"> message number {max(0, k - 4)} says this\nagain {k} and on") for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = sorted(map(tuple, quotes.linked(df).collect()))
    monkeypatch.setattr(quotes, "STRETCH", 7)
    assert sorted(map(tuple, quotes.linked(df).collect())) == whole
    assert len({r[7] for r in whole}) > 5 and sorted(r[9] for r in whole) == list(range(60))


def test_quotes_odd(spark):
    long = "\n".join("> " * (k % 4) + f"line {k} of a long text" for k in range(20000))
    rows = [(1, 0, "a", None), (1, 1, None, long), (1, 1, None, long), (None, 3, "a", "x"), (2, None, "a", "> y"), (3, 5, "a", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as own", "2 as stretch", "3 as branch")
    got = quotes.linked(df)
    assert got.count() == 6 and {(r.conv_id, r.turn, r.branch) for r in got.collect()} == {(1, 0, 0), (1, 1, 0), (None, 3, None), (2, None, None), (3, 5, 0)}
    assert quotes.linked(df.limit(0)).count() == 0


# --- the pipeline


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = cases.documents(spark, cases.corpus(11, 80))
    d = tables(spark, tmp_path, docs)
    cols = docs.columns
    own = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, own, d)
        if k < 4:
            assert out.columns == cols, name
            path = str(tmp_path / f"s{k}")
            out.write.parquet(path)
            own = spark.read.parquet(path)
    run = corpus_pipeline.run(spark, d)
    assert {(r.doc_id, r.start, r.length) for r in run.collect()} == {(r.doc_id, r.start, r.length) for r in out.collect()}


def test_near_copies_go_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [cases.sentence(rng, rng.randrange(80, 300), 9999) for _ in range(40)]
    planted = []
    for k in range(40):  # words changed, so many that 0.8 of the five-word shingles are left, or nearly so many
        w = texts[k].split(" ")
        for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[at] = f"new{k}"
        planted.append(" ".join(w))
    docs = cases.documents(spark, texts + planted)
    shingles = lambda t: {tuple(t.split(" ")[i : i + 5]) for i in range(len(t.split(" ")) - 4)}
    alike = {40 + k for k in range(40) if 100 * len(shingles(texts[k]) & shingles(planted[k])) >= 80 * len(shingles(texts[k]) | shingles(planted[k]))}
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert set(range(80)) - left == alike and len(alike) > 25


@pytest.mark.parametrize("make", [cases.odd, cases.empty])
def test_pipeline_stages_on_odd_input(spark, tmp_path, make):
    import corpus_pipeline

    docs = make(spark)
    d = tables(spark, tmp_path, docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert out.count() >= 0 and (k == 4 or out.columns == docs.columns)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in registry.queries()])
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in registry.oracle_sql()])
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert set(got.columns) == set(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a href=\"" * 110_000, "<div>" * 200_000, "<div>" * 100_000 + "</b>" * 120_000, "<ul>" + "<div>" * 80_000 + "<li>" * 120_000, "<p><button>" + "<div>" * 200_000, "<title>" * 140_000, "<div class='" + "x" * 500_000 + "'>" + "<div>t" * 80_000, "<!-- " * 200_000])
def test_malformed_pages_take_linear_time(page):
    begin = time.time()
    html.fields(page)
    assert time.time() - begin < 5


def test_a_break_that_need_not_be_is_no_blank():
    assert [f[1] for f in html.fields("<p>hyphen<wbr>ation and<br>more</p>")] == ["hyphenation and more"]


def test_paths_of_deep_elements_differ():
    found = html.fields("<div>" * 900 + "x" + "<div>y</div>" + "</div>" * 900 + "z")
    assert [f[1] for f in found] == ["x", "y", "z"] and len({f[0] for f in found}) == 3 and max(len(f[0]) for f in found) < 2 * html.PATH_MOST
