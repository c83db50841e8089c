"""Operator 6 on written pages with known articles, and tree matching against brute force."""

import random

from quartzline.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/a>Home {i}</a><li>About</ul></nav><!-- ad --><div class="ad">Buy {i}</div>
{open}<h1>Head &amp; shoulders {i}</h1><p>First   <b>bold</b>
text {i}.<p>Second &eacute;t&#233; {i}<br>goes on.<div class="share">Share</div><form>Mail <input></form>{close}
<div id="comments"><p>Nice post {i}!</div><aside>More</aside><footer>&copy; host {i}</footer></body></html>"""


def test_known_articles(spark):
    rows, want = [], {}
    for i in range(24):
        open_, close = ("<article>", "</article>") if i % 2 else ("<div class=story>", "</div>")
        rows.append((i, f"https://www.h{i % 2}.example/p/{i}?x=1", PAGE.format(i=i, open=open_, close=close), True))
        want[i] = f"Head & shoulders {i}\nFirst bold text {i}.\nSecond été {i} goes on."
    rows += [(100, None, None, True), (101, "::bad url", "", True), (102, "http://x.y/", "<p>plain &lt;b&gt; <i>t", True), (103, "http://x.y/", "<nav>only</nav>", True), (104, "http://z.y/", "no markup " * 20000, True)]
    want |= {100: "", 101: "", 102: "plain <b> t", 103: "", 104: ("no markup " * 20000).strip()}
    pages = spark.createDataFrame(rows + [rows[3]], "page_id long, url string, html string, Text2 boolean")
    got = html_main.extract_main(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert html_main.extract_main(pages.filter("false")).collect() == []


def test_simple_tree_matching_brute():
    rng = random.Random(3)

    def tree(depth):
        return [rng.choice("ab"), False, [tree(depth - 1) for _ in range(rng.randrange(0, 3) if depth else 0)]]

    def best(x, y):
        if x[0] != y[0]:
            return 0

        def lists(p, q):
            return max(lists(p[1:], q), lists(p, q[1:]), best(p[0], q[0]) + lists(p[1:], q[1:])) if p and q else 0

        return 1 + lists(x[2], y[2])

    for _ in range(200):
        a, b = tree(3), tree(3)
        m = html_main.match_trees(a, b)
        assert len(m) == best(a, b)
        assert sorted(m) == [k for k, _ in sorted(m.items(), key=lambda p: p[1])]


def test_nothing_varying_is_left_beside_the_content(spark):
    long = "a long sentence of this page with many words in it " * 6
    forms = [
        lambda i: (f"<h1>Title {i}</h1><div class=body><p>{long}{i}</p><p>Second {i}</p></div>", [f"Title {i}", f"{long}{i}", f"Second {i}"]),
        lambda i: (f"<div class=intro><p>{long}{i}</p></div><div class=body><p>Short {i}</p><p>{long}two {i}</p><p>End {i}</p></div>", [f"{long}{i}", f"Short {i}", f"{long}two {i}", f"End {i}"]),
        lambda i: (f"<div class=intro><div><p>{long}{i}</p></div></div><div class=body><div><p>Fixed</p><p>Other {i}</p></div></div>", [f"{long}{i}", "Fixed", f"Other {i}"]),
    ]
    rows, want = [], {}
    for i in range(30):
        inner, blocks = forms[i % 3](i)
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body><header>Site</header><nav><p>Menu {i}</p></nav><div class=post>{inner}</div><footer>End</footer></body></html>"))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_deep_nesting_and_odd_hosts(spark):
    deep = "<div>" * 5000 + "<p>deep {i}</p>" + "</div>" * 5000 + "<p>after {i}</p>"
    spans = "<p>" + "<b>" * 3000 + "bold {i}" + "</b>" * 3000 + " plain"
    rows, want = [], {}
    for i, (url, html, text) in enumerate([("http://my_site.com/a", deep, "deep {i}\nafter {i}"), ("http://h.com/a b|c", deep, "deep {i}\nafter {i}"), ("http://u@h.com:80/x", spans, "bold {i} plain")] * 3):
        rows.append((i, url, html.replace("{i}", str(i))))
        want[i] = text.replace("{i}", str(i))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.extract_main(pages).collect()} == want
    assert {r[0] for r in pages.select(html_main.host_of(pages.url)).collect()} == {"my_site.com", "h.com"}


def test_constant_nodes_are_template_wherever_they_are(spark):
    def page(i, tail):
        return f"<html><body><article><div class=box>Join the club, it costs nothing.</div><h1>Title {i}</h1><p>Text {i} of <b>page</b></p><p>We wrote this with care.</p>{tail}<div class=end>Fixed <a href=#>link</a><div class=by>By author {i}</div></div></article></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i, f"<p>Last {i}</p>" if i % 2 else "")) for i in range(20)]
    want = {i: "\n".join([f"Title {i}", f"Text {i} of page", "We wrote this with care.", *([f"Last {i}"] if i % 2 else []), f"By author {i}"]) for i in range(20)}
    # too few different pages for a template, and one article many times
    rows += [(100 + i, f"http://b.example/{i}", page(i % 4, "")) for i in range(12)]
    rows += [(200 + i, "http://c.example/same", page(7, "")) for i in range(12)]
    whole = lambda i: "\n".join(["Join the club, it costs nothing.", f"Title {i}", f"Text {i} of page", "We wrote this with care.", "Fixed link", f"By author {i}"])
    want |= {100 + i: whole(i % 4) for i in range(12)} | {200 + i: whole(7) for i in range(12)}
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_varying_text_decides_against_a_small_article(spark):
    body = "a long sentence of this page with many words in it " * 5
    rows = [(i, f"http://a.example/{i}", f"<body><article><p>Teaser {i}</p></article><div class=story><h1>Head {i}</h1><p>{body}{i}</p></div></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser {i}\nHead {i}\n{body}{i}" for i in range(8)}
