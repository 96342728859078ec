from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

from glossa.llm import html_extract as he


def text(html, low=()):
    return he.main_text(html, set(low))


def test_named_branches_go():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>'</script></head><body class='home nav-open'><nav><ul><li>m</ul></nav><!-- c --><div class='site-ad'>ad</div>"
        "<header>head</header><article><h1>T &amp; t</h1><p><b>One<br>two <p>three &lt;b&gt;</p><div class='share-bar'>share</div><aside>side</aside><section id=comments><p>c</section><form>f</form><p>&#233;&nbsp; x</article><p>after<footer>foot"
    )
    assert text(page) == "T & t\n\nOne two\n\nthree <b>\n\né x"


def test_pages_without_article():
    assert text('<div class="siteNav">x</div><p>Hi<ul><li>a<li>b</ul><p title="a>b">z <span class=ad>k</span>w') == "Hi\n\na\n\nb\n\nz w"
    assert text(None) == text("") == text("<script>x") == text("<!-- x") == ""
    assert text("a < b & c &bogus; <") == "a < b & c &bogus; <"
    assert text("<div " + "x" * 50_000) == ""


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x") == "x"
    long = "word " * 100_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()


def pages(spark):
    top = "<div class=a><p>same top on every page</p></div>"
    rows = [(i, f"http://h.org/{i}", f"<body>{top}<div class=b><p>own text {i}</p><p>more {i * 7}</p></div><article></article></body>", "x") for i in range(20)]
    rows += [(100 + i, "http://copy.org/", "<article><p>the same article</p></article>", "x") for i in range(10)]
    return spark.createDataFrame([*rows, (200, None, None, "x"), (201, "not a url", "<p>q", "x")], "page_id long, url string, html string, n_chars string")


def test_what_every_page_of_a_host_says_goes(spark):
    rows = {r["page_id"]: (r["text"], r["n_chars"]) for r in he.extract(pages(spark), ["page_id", "url"]).collect()}
    assert rows[3] == ("own text 3\n\nmore 21", 19)
    assert all(rows[100 + i][0] == "the same article" for i in range(10))  # a marked article stays, however often it is there
    assert rows[200] == ("", 0) and rows[201][0] == "q" and len(rows) == 32


def test_importance(spark):
    tree = {r["importance"] for r in he.style_tree(pages(spark)).where("pages = 20").collect()}
    assert min(tree) < 0.1 and max(tree) > 0.7
    assert he.extract(pages(spark).limit(0), ["page_id"]).count() == 0


def test_the_tree_judges_inside_and_outside_of_articles(spark):
    article = "<article><p>text {0} of its own</p><p>more {1}</p><div class=x1><p>the same box in every article</p></div></article>"
    rows = [(i, f"http://a.org/{i}", article.format(i, i * 7)) for i in range(20)]
    # a teaser that is an article, beside the text itself
    rows += [(100 + i, f"http://b.org/{i}", f"<article class=t><p>teaser</p></article><div class=m><p>long own text {i}</p></div><div class=z>same foot</div>") for i in range(20)]
    # copies of one article, some of others, each with the box
    rows += [(200 + i, f"http://c.org/{i}", article.format(max(i, 30), max(i, 30))) for i in range(40)]
    # a host of one page gives the tree no ground
    rows += [(300, "http://d.org/", article.format(1, 2))]
    got = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert [got[i] for i in range(20)] == [f"text {i} of its own\n\nmore {i * 7}" for i in range(20)]
    assert [got[100 + i] for i in range(20)] == [f"teaser\n\nlong own text {i}" for i in range(20)]
    assert [got[200 + i] for i in range(40)] == [f"text {max(i, 30)} of its own\n\nmore {max(i, 30)}" for i in range(40)]
    assert got[300] == "text 1 of its own\n\nmore 2\n\nthe same box in every article"


def test_names_of_an_articles_own_parts_stay():
    page = "<article><p>He said <span class='notice'>look</span> here.</p><div class='related-work'>Others did.</div><section class='discussion'>We think.</section></article>"
    assert text(page) == "He said look here.\n\nOthers did.\n\nWe think."
    assert text("<div class='notice'>x</div><p>y") == "y"
    for wrapper in ("<div class='content has-sidebar'>", "<div class='entry no-comments'>", "<div class='related'>"):
        assert text(f"{wrapper}<article class='post social-policy'><p>text</p></article></div>") == "text"
    # an article that is a comment goes beside another one
    assert text("<article><p>long enough text</p></article><section class='comments'><article><p>I disagree with all of it at length</p></article></section>") == "long enough text"


def test_teasers_go():
    page = "<main><h1>T</h1><article><p>" + "the text of the page " * 10 + "</p></article><article class=card><p>read this too</p></article></main>"
    assert text(page) == "T\n\n" + ("the text of the page " * 10).strip()


def test_references_are_decoded_in_each_text_node():
    assert text("<p>&am<b>p;lt</b>;</p>") == "&amp;lt;"
    assert text("<p>&amp;lt; &#x41;&#66;&copy &nbsp;x</p>") == "&lt; AB\u00a9 x"


def test_broken_pages_take_time_in_proportion():
    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<p>x" + "<b>" * n + "x</p>" * n, lambda n: "<p><option>" + "<b>" * n + "<div>x</div>" * n, lambda n: "<ul>" + "<li><b>x" * n, lambda n: "<div><p>" * n + "</p>" * n):
        took = []
        for n in (4000, 32000):
            began = time.time()
            he.parse(make(n))
            took.append(time.time() - began)
        assert took[1] < 40 * max(took[0], 0.01)


def importance_by_hand(rows):
    """Per site and node: pages (different articles count once each inside articles) and importance, straight from the definition."""
    styles, texts, seen, outside = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    once = set()
    for site, html in rows:
        blocks, elements = he.parse(html or "")
        article = tuple(b.text for b in blocks if b.main and not b.hard and not b.named)
        items = {(0, node, children, main) for node, main, children in elements} | {(1, b.node, b.text, b.main) for b in blocks}
        items |= {(2, node, "", main) for _, node, _, main in items}
        for kind, node, item, main in items:
            if main:
                if (site, kind, node, item, article) in once:
                    continue
                once.add((site, kind, node, item, article))
            else:
                outside.add((site, node))
            (styles, texts, seen)[kind][site, node][item] += 1
    entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values())
    out = {}
    for key, count in seen.items():
        pages = count.total()
        base = math.log(max(pages, 2))
        p, t = styles[key], texts[key]
        shape = entropy(p) / base if p else 0.0
        # 1 - sum n ln n / (total ln pages)
        content = 1 - sum(n * math.log(n) for n in t.values()) / t.total() / base if t else 0.0
        out[key] = (pages, 1.0 if pages < 2 else shape if not t else he.PRESENTATION * shape + (1 - he.PRESENTATION) * content)
    return out


def test_importance_against_the_definition(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["<p>same</p>", f"<p>own {rng.random()}</p>", "<ul><li>a<li>b</ul>", f"<div class={rng.choice('ab')}>{rng.choice(['x', 'y', 'z'])}</div>", "<div class=notice>cookies</div>"])
    rows = []
    for i in range(120):
        inside = "".join(part() for _ in range(rng.randrange(4)))
        rows.append((i, f"https://{rng.choice(['a', 'b'])}.org/{i}", "".join(part() for _ in range(rng.randrange(4))) + rng.choice(["", f"<article>{inside}</article>", "<article><p>copy</p></article>"])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["site"], r["node"]): (r["pages"], round(r["importance"], 9)) for r in he.style_tree(df).collect()}
    sites = {r["page_id"]: r["site_"] for r in he._host(df, "url").collect()}
    want = {k: (n, round(x, 9)) for k, (n, x) in importance_by_hand([(sites[i], html) for i, _, html in rows]).items()}
    assert got == want and len(got) > 20


def test_the_tree_brings_texts_nearer_to_the_truth(spark):
    """Boxes without telling names, inside and beside the article."""
    rows, truth = [], {}
    for i in range(60):
        own = [f"sentence {i} {k}" for k in range(3)]
        rows.append((i, f"http://t.org/{i}", "<div class=x9>Welcome to our site</div><article>" + "".join(f"<p>{t}</p>" for t in own) + "<div class=q1>Our offers this week</div></article><div class=x8>Call us</div>"))
        truth[i] = "\n\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in he.extract(df, ["page_id"]).collect()} == truth
    assert all(he.main_text(h, set()) != truth[i] for i, _, h in rows)


def test_hosts_with_many_nodes_give_the_same_texts(spark, monkeypatch):
    df = pages(spark)
    rows = [(300 + i, f"http://w.org/{i}", f"<body><div class=t>top</div><div class=c{i % 4}><p>own {i}</p><p>foot</p></div></body>", "x") for i in range(60)]
    df = df.unionByName(spark.createDataFrame(rows, df.schema))
    want = sorted(he.extract(df, ["page_id", "url"]).collect(), key=str)
    monkeypatch.setattr(he, "LISTED", 3)
    assert sorted(he.extract(df, ["page_id", "url"]).collect(), key=str) == want


def test_a_host_with_most_pages_and_repeated_rows(spark):
    rows = [(i, "http://hot.org/x", f"<div class=a>same box</div><div class=b><p>own text {i}</p></div>") for i in range(400)]
    rows += rows[:5] + [(1000 + i, f"http://h{i}.org/", "<p>alone</p>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    got = sorted((r["page_id"], r["text"]) for r in he.extract(df, ["page_id"]).collect())
    assert got == sorted([(i, f"own text {i}") for i in [*range(400), *range(5)]] + [(1000 + i, "alone") for i in range(40)])
