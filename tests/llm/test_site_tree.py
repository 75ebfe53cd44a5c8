import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry.llm import site_tree

NOTICE = "We keep your settings. Read all about it in our policy."


def page(i, body="", extra=""):
    return f"<html><head><title>T{i}</title></head><body><div class=box{i % 3}><p>{NOTICE}</p></div><div id=story><h1>Head {i}</h1><p>Own text of page {i}.</p>{body}</div>{extra}</body></html>"


def run(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_tree.extracted(df).collect()}


def alone(html):
    """The blocks of a page that is alone on its host: what a hint or a declared role is on goes."""
    blocks, nodes = site_tree.parse(html)
    hinted = {p for p, n in nodes.items() if n[2] in ("hinted", "comments")}
    kept = ["".join(t for p, t in b if not p or not hinted & set(nodes[p][1])) for b in blocks]
    return [" ".join(t.split()) for t in kept if t.strip()]


def test_what_markup_declares(spark):
    html = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body>
    <header>Site head</header><nav><ul><li><a href=/x>Menu</a></li></ul></nav><!-- note --><div class="ad top">Buy</div>
    <main><article><header><h1>The &amp; title &eacute;&#33;</h1></header><p><b>One
    two<br><p>Three  four &nbsp; five</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
    <form>Send <button>now</button></form><aside>Side</aside><div class="comments"><p>Reader</p></div>tail</article></main>
    <div id="cookie-notice">Cookies</div><footer>&copy; all</footer></body></html>"""
    assert run(spark, [("http://a.org/1", html)])[0] == "The & title é!\nOne two\nThree four five\na\nb\nc\nd\ntail"


def test_class_names_that_speak_of_other_parts(spark):
    html = """<body class="has-sidebar search-page"><div class="wrap with-comments no-ads"><article class="post sidebar-left"><div class="article-header"><h1>Title</h1></div><p class="lead">Text</p>
    <div class="share-bar">Share</div></article><article class="comment"><p>Reader</p></article><div class="site-header">Head</div><div class="ad-slot">Ad</div><div class="roadmap">Plan</div></div></body>"""
    assert run(spark, [("http://a.org/1", html)])[0] == "Title\nText\nPlan"


def test_hints_on_what_holds_the_article():
    text = alone
    for c in ("content-sidebar-wrap", "layout sidebar-right", "wrapper header-fixed", "search", "sidebar", "menu page"):
        for tag in ("main", "article"):
            assert text(f'<body><div class="{c}"><{tag}><p>Own text</p></{tag}></div><div class="share">Share</div>') == ["Own text"]
    article = '<article><section id="search-algorithms"><h2 id="related-work">Related</h2><p>One</p></section><section id="search"><h2 id="comments">Two</h2></section>{}</article>'
    assert text(article.format('<div class="comments"><article>Reader</article></div><p>a <span class="ad">Buy</span>b</p>')) == ["Related", "One", "Two", "a b"]
    assert text('<div class="related"><article>Only one</article></div>') == ["Only one"]
    assert text('<div id="sidebar"><p>Most of the text of this page</p></div><div class="menu">Menu</div>') == ["Most of the text of this page"]
    assert text('<div class="story">Most of the text of this page</div><div class="site-menu">Menu</div>') == ["Most of the text of this page"]


def test_left_out_elements_at_the_beginning_of_a_block():
    for tag in ("button", "script", "style", "label", "svg", "select", "noscript", "textarea", "object"):
        for block in ("p", "div", "td", "body"):
            html = f"<{block}><{tag}>Copy</{tag}>Own <b>text</b> <{tag}>Copy</{tag}>here</{block}>"
            assert alone(html) == ["Own text here"], html


def test_omitted_tags_of_the_page():
    head = "<title>T</title><meta charset=utf-8><style>p{}</style><noscript><link href=x></noscript>"
    for begin in ("<html><head>", "<head>", "<html>", ""):
        for end in ("</head><body>", "<body>", "</head>", ""):
            for tail in ("", "</body></html>"):
                for body in ("<article><p>Own text</p></article>", "<p>Own text", "<x-part>Own text</x-part>", "Own text"):
                    assert alone(begin + head + end + body + tail) == ["Own text"]


def test_template_of_a_host_is_removed_by_the_tree_alone(spark):
    pages = [(f"https://Site.example.org:80/{i}?q", page(i)) for i in range(12)] + [("http://other.org/", page(99))]
    got = run(spark, pages)
    for i in range(12):
        assert got[i] == f"Head {i}\nOwn text of page {i}."
    assert got[12] == f"{NOTICE}\nHead 99\nOwn text of page 99."  # one page says nothing about its host


def test_copies_of_a_page_are_no_template(spark):
    same = [("http://h.org/", page(1))] * 30 + [(f"http://h.org/{i}", page(i)) for i in range(2, 4)]
    assert "Own text of page 1." in run(spark, same)[0]
    inside = [("http://m.org/", f"<article><p>Same line.</p><p>Own {i}.</p></article>") for i in range(20)]
    assert run(spark, inside)[3] == "Same line.\nOwn 3."


def test_pages_whose_names_only_look_like_hints():
    form = '<body><form id="aspnetForm" method="post"><input type=hidden><div class="content"><p>Own text</p><p>More of it</p></div><select><option>x</select></form></body>'
    assert alone(form) == ["Own text", "More of it"]
    assert alone('<body><p>Own text of the page</p><form>Send us mail</form></body>') == ["Own text of the page"]
    assert alone('<body><form><article><p>Own text</p><form>Send</form></article></form></body>') == ["Own text"]
    for name in ('class="search-result article-body"', 'id="notice-of-appeal"', 'class="social-sciences"'):
        assert alone(f"<body><div {name}><p>Own text</p></div></body>") == ["Own text"]
    assert alone('<article><section class="related-work"><h2>Related work</h2><p>Text</p></section></article>') == ["Related work", "Text"]


def test_hints_are_a_prior(spark):
    """A hinted part with text of its own goes; one that is laid out in many ways, as articles are, stays."""
    tags = ("p", "h2", "ul", "table", "blockquote", "pre", "dl", "h3")
    rich = lambda i: "<hr>".join(f"<{tags[i // 8**k % 8]}>Part {i} {k}</{tags[i // 8**k % 8]}>" for k in range(3))
    ads = [("http://r.org/", f"<p>Own text of page {i}</p><div class=ad><p>Buy {i * 7}</p></div>") for i in range(200)]
    got = run(spark, ads + [("http://q.org/", f"<p>{'Own text ' * 12}{i}</p><div class=notice>{rich(i)}</div>") for i in range(200)])
    assert all(got[i] == f"Own text of page {i}" for i in range(200))
    assert all(f"{i}\nPart {i} 0" in got[200 + i] for i in range(200))


def test_depth_and_size_stay_linear():
    import time

    began = time.time()
    for tag in ("div", "b", "span", "p", "li"):
        blocks, nodes = site_tree.parse(f"<{tag} class=x>" * 40000 + "deep" + f"</{tag}>" * 40000)
        assert ["".join(t for _, t in b).strip() for b in blocks] == ["deep"]
        assert all(len(n[1]) <= site_tree.DEPTH for n in nodes.values())
    assert time.time() - began < 20


def test_importance_against_the_formula(spark):
    pages = [("http://s.org/", page(i, "<p>More.</p>" * (i % 2), f"<div class=ad>Ad {i}</div><article><p>Same.</p></article>")) for i in range(9)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    given = df.select("page_id", "url", "html", site_tree.host_of(F.col("url")).alias("host"))
    parsed = given.mapInArrow(site_tree._parse_batches, site_tree.PARSED)
    got = {r["path"]: r for r in site_tree.style_tree(*site_tree._spread(parsed)).collect()}
    nodes, feats, above, kinds = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}, {}
    for r in parsed.collect():
        for n in r["nodes"]:
            nodes[n["path"]][n["shape"]].add(r["digest"])
            above[n["path"]], kinds[n["path"]] = n["above"], n["kind"]
            for f in n["features"]:
                feats[n["path"]][f].add(r["digest"])
    assert set(kinds.values()) == {"plain", "hinted", "main"} and set(got) == set(nodes)
    for path, shapes in nodes.items():
        m = len(set().union(*shapes.values()))
        look = -sum(len(d) / m * math.log(len(d) / m, m) for d in shapes.values()) if m > 1 else 1.0
        content = [1 - math.log(len(d), max(2, len(set().union(*nodes[p].values())))) for p in feats if path in above[p] for d in feats[p].values()]
        g = site_tree.DAMPING ** len(shapes)
        want = (1 - g) * look + g * sum(content) / len(content) if m >= site_tree.MIN_PAGES else site_tree.UNMEASURED
        odds = min(0.99, max(0.01, want))
        odds = math.log(odds / (1 - odds)) + {"plain": 0, "hinted": -4, "main": 4}[kinds[path]]
        assert got[path]["pages"] == m and got[path]["composite"] == pytest.approx(want)
        assert got[path]["importance"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_an_unmarked_line_that_all_pages_repeat_goes(spark):
    body = lambda i, line: f"<html><body><div id=story><h1>Title {i}</h1><p>Paragraph {i} of its own.</p><p>{line}</p><p>Ending {i} here.</p></div></body></html>"
    rows = [("http://a.org/", body(i, "Subscribe to our newsletter today")) for i in range(8)]
    rows += [("http://b.org/", body(i, "Subscribe to our newsletter today" if i else "A line of the first page")) for i in range(9)]  # on all pages but one
    rows += [("http://c.org/", body(i, "Too few pages tell nothing")) for i in range(7)]
    found = run(spark, rows)
    got = [found[i] for i in range(len(rows))]
    assert got[:8] == [f"Title {i}\nParagraph {i} of its own.\nEnding {i} here." for i in range(8)]
    rows = [(u, h.replace("div id=story", "article").replace("</div>", "</article>")) for u, h in rows]
    again = run(spark, rows)
    assert all("newsletter" in again[i] for i in range(8))  # the article's markup vouches for it
    assert all("newsletter" in t for t in got[9:17]) and "first page" in got[8] and all("Too few" in t for t in got[17:])


@pytest.mark.parametrize("name", ["id=comments-area", "class=comment-body", "class=post-comments", "class=user-comments-wrapper", "class=comments", "id=comment-list-12"])
def test_reader_comments_go(spark, name):
    rows = []
    for i in range(9):  # as rich in structure as an article
        comments = "".join(f"<div class=entry><b>User {i}{k}</b><p>I think {k} of {i}.</p>{'<ul><li>a<li>b</ul>' * (k % 2)}</div>" for k in range(i))
        rows.append(("http://a.org/", f"<body><article class='post comments-open'><h1>T {i}</h1><p>Text {i}.</p></article><div {name}>{comments}</div></body>"))
    assert run(spark, rows) == {i: f"T {i}\nText {i}." for i in range(9)}


def test_a_page_within_a_container_named_after_comments_stays(spark):
    assert run(spark, [("http://a.org/", "<div class='page-with-comments'><article><p>Text.</p></article></div>"), ("http://a.org/", "<body class=comments><p>On its own.</p></body>")]) == {0: "Text.", 1: "On its own."}


def test_odd_pages(spark):
    rows = [(None, None), ("", ""), ("x", "just text & no markup"), ("http://u.org", "<p>cut &am"), ("http://u.org", "<p>a</b></i></div>b<td>c"), ("http://u.org", "<" * 50), ("http://v.org/", "<p>" + "long " * 50000), ("http://v.org/", "<script>never closed"), ("no url", "<article><p>x")]
    got = run(spark, rows)
    assert len(got) == len(rows) and got[0] == got[1] == "" and got[2] == "just text & no markup" and got[3] == "cut &am"
    assert got[6] == ("long " * 50000).strip() and got[7] == "" and got[8] == "x"
    twice = spark.createDataFrame([(1, "http://a/", "<p>q"), (1, "http://a/", "<p>q")], "page_id long, url string, html string")
    assert [r["text"] for r in site_tree.extracted(twice.withColumn("TEXT", F.lit("clash")).withColumn("host", F.lit("h"))).collect()] == ["q", "q"]
    assert site_tree.extracted(twice.limit(0)).count() == 0


def test_query(spark):
    """The article of every page of the driver's tables, taken out by a pattern."""
    import html
    import re

    from docquarry.llm.queries import op5_site_style_tree

    d = "/root/testdata/sf0.01"
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in op5_site_style_tree(spark, d).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article[1])]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
