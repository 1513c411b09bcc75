import random
import time

import numpy as np

from strandlake.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="home"><!-- <p>gone</p> --><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>
<div id="cookie-notice">We use</div><article class="post"><header><h1>A &amp; B</h1><p>by me</p></header><p>One&nbsp;<b>two</b>
three<br>four<p>five &lt;six&gt; &eacute; &#233; &#x1F642;<ul><li>x<li>y</ul><aside>side</aside><form><p>mail</p></form><div class="share-buttons">tweet</div>
<table><tr><td>c1</td><td>c2</td></tr></table><section class="comments"><p>nice!</p></section><div style="display: none">hid</div></article>
<aside>related</aside><footer>&copy; me</footer></body></html>"""


def test_structure():
    assert html.blocks_of(PAGE)[0] == ["A & B", "One two three four", "five <six> é é 🙂", "x", "y", "c1", "c2"]


def test_odd_markup():
    assert html.blocks_of("") == ([], [])
    assert html.blocks_of("plain &amp text") == ([], ["plain & text"])
    assert html.blocks_of("<article><p>a</p><p>b <foo") == (["a", "b"], [])
    assert html.blocks_of("<article><p>a</p><!-- open <p>b</p>") == (["a"], [])
    assert html.blocks_of("</div></p><ARTICLE>x</ARTICLE>y") == (["x"], ["y"])
    assert html.blocks_of('<article><p title="a>b">q</p><script>"<p>"') == (["q"], [])
    assert html.blocks_of("<main><p>1 < 2 and 3 > 2</p></main>") == (["1 < 2 and 3 > 2"], [])


def test_other_landmarks():
    assert html.blocks_of('<p>x</p><div role="main"><p>a</p></div>') == (["a"], ["x"])
    assert html.blocks_of('<div itemprop="articleBody">a</div>') == (["a"], [])
    assert html.blocks_of('<article><p>a</p><article class="comment">c</article></article><article class="comment-box">d</article>') == (["a"], [])
    assert html.blocks_of('<div class="ad">buy<article><p>a</p><nav>n</nav></article>') == (["a"], [])
    assert html.blocks_of('<p>text</p><section class="comments"><article>c</article></section>') == ([], ["text"])


def test_suffix_order():
    draw = random.Random(2)
    for _ in range(30):
        v = [draw.randrange(3) for _ in range(draw.randrange(1, 40))]
        assert html.suffix_array(np.array(v)).tolist() == sorted(range(len(v)), key=lambda i: v[i:])


def test_runs_against_brute_force():
    draw = random.Random(5)
    for _ in range(40):
        pages = [[" ".join(draw.choices("abcd", k=draw.randrange(1, 14))) for _ in range(draw.randrange(4))] for _ in range(6)]
        where, run = {}, 3
        padded = [[b.split() + [""] * (run - len(b.split())) for b in page] for page in pages]
        for o, page in enumerate(padded):
            for s in page:
                for i in range(len(s) - run + 1):
                    where.setdefault(tuple(s[i : i + run]), set()).add(o)
        streams = html.Streams(pages, run)
        prints, counts = streams.repeated()
        assert sorted(counts.tolist()) == sorted(map(len, where.values())) and len(set(prints.tolist())) == len(where)
        often = {r for r, o in where.items() if len(o) >= 2}
        kept = []
        for page, blocks in zip(padded, pages, strict=True):
            cover = [[any(0 <= i <= len(s) - run and tuple(s[i : i + run]) in often for i in range(k - run + 1, k + 1)) for k in range(len(s))] for s in page]
            kept.append([b for b, c in zip(blocks, cover, strict=True) if 2 * sum(c) <= len(c)])
        assert streams.without(prints[counts >= 2]) == kept


def test_extract(spark):
    rows = [(k, f"http://h.example.org/{k}", f"<div>Home</div><div>About this site and us</div><p>own words number {k} on page {k * 7} here</p>", "x") for k in range(300)]
    rows += [(900, "http://h.example.org/a", PAGE, "x"), (901, None, None, "x"), (902, "odd", "", "x"), (903, "http://other.example.org/", "<p>About this site and us</p>", "x"), (904, "u", "<article></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert len(got) == 305
    assert all(got[k] == f"own words number {k} on page {k * 7} here" for k in range(300))
    assert got[900].startswith("A & B\n\nOne two three four\n\nfive") and got[901] == got[902] == got[904] == ""
    assert got[903] == "About this site and us"
    assert html.extract(df.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    rows = [(k, "http://h/", "<nav>menu</nav><article><p>the same article text on every page of it</p></article>") for k in range(20)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the same article text on every page of it"} and len(got) == 20


def test_copied_pages_without_an_article_stay(spark):
    page = "<div>the same text on every copy of it</div><p>and a second paragraph of the same page</p>"
    text = "the same text on every copy of it\n\nand a second paragraph of the same page"
    rows = [(1, "http://h/", page)] * 3 + [(k, f"http://copies/{k}", page) for k in range(2, 300)]
    rows += [(1000 + k, f"http://menus/{k}", f"<div>home and about this site</div><p>own{k} words{k} of{k} page{k} once{k}</p>") for k in range(2)] * 3
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id < 1000} == {text}
    assert all(r.text.startswith("home and about this site") for r in got if r.page_id >= 1000)


def _large_host():
    rows = [(k, f"http://large/{k}", f"<p>own{k} words{k} of{k} page{k} once{k}</p>" + "<div>a rare notice about this site</div>" * (k % 500 < 3) + "<div>Menu</div>" * (k % 700 == 1) + "<div>said on two pages only here</div>" * (k in (8, 2008))) for k in range(2600)]
    return rows, {k: f"own{k} words{k} of{k} page{k} once{k}" + "\n\nsaid on two pages only here" * (k in (8, 2008)) for k in range(2600)}


def test_boilerplate_is_counted_over_the_whole_host(spark):
    rows, want = _large_host()
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_groups_of_a_host_give_what_one_group_gives(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(k, "http://h/", "".join(f"<p>{' '.join(draw.choices('abc', k=draw.randrange(1, 9)))} {draw.randrange(40)}</p>" for _ in range(4))) for k in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {r.page_id: r.text for r in html.extract(df).collect()}
    monkeypatch.setattr(html, "HOST_PAGES", 5)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == one and len(set(one.values())) > 50


def _article_host(copies):
    menu = "<p>all our guides and offers at a glance</p>"
    own = {k: " ".join(f"own{k}x{i}" for i in range(12)) for k in range(40)}
    rows = [(k, f"http://h/{k}", f"<main>{menu}<p>{own[k]}</p><p>See all</p></main>") for k in range(40)]
    near = {k: f"a copied article whose text is the same on each page but for one word {k}" for k in range(100, 110)}
    rows += [(k, f"http://h/{k}", f"<article><p>{x}</p></article>") for k, x in near.items()] * copies
    # A line that is on less than half of the pages is main text.
    some = {200 + k: f"Said before on some pages of this host.\n\nmore{k} words{k} of{k} its{k} own{k} here{k} and{k} there{k}" for k in range(12)}
    rows += [(k, f"http://h/{k}", "<article>" + "".join(f"<p>{b}</p>" for b in x.split("\n\n")) + "</article>") for k, x in some.items()]
    # All pages of a host are copies of one another.
    same = {300 + k: f"the very same words on all pages of this host but one {k}" for k in range(30)}
    rows += [(k, "http://copies/", f"<article><p>{x}</p></article>") for k, x in same.items()]
    return rows, own | near | some | same


def test_boilerplate_inside_main_goes_and_copied_articles_stay(spark, monkeypatch):
    rows, want = _article_host(3)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for pages, held, large in ((html.HOST_PAGES, html.BROADCAST_BYTES, html.LARGE_HOSTS), (6, -1, 1), (6, html.BROADCAST_BYTES, 0), (4, -1, html.LARGE_HOSTS)):
        monkeypatch.setattr(html, "HOST_PAGES", pages)
        monkeypatch.setattr(html, "BROADCAST_BYTES", held)
        monkeypatch.setattr(html, "LARGE_HOSTS", large)
        got = html.extract(df).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_long_pages_take_linear_time():
    began = time.perf_counter()
    page = "<div>" * 100_000 + "</span>" * 100_000 + "text"
    assert html.blocks_of(page) == ([], ["text"])
    assert html.blocks_of("<article>" + "<p>x <b>y</b></p>" * 50_000)[0] == ["x y"] * 50_000
    assert time.perf_counter() - began < 10
