import pytest

from sightline.llm import html_wrappers as H

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style></head><body><div class="site">Our slogan</div>
<nav><ul><li><a>One {n}<li><a>Two</ul></nav><div class="content"><h1>Head {n} &amp; more</h1><p>First&nbsp;{n}
 line<br>on <b>two</b> rows<p>Second {n} &eacute; &#233; &bogus; <i>x</i></p><ul><li>a{n}<li>b</ul></div>
<div id="comments"><p>Reader {n}</p></div><form><input value=1>Send {n}</form><script>var t = "<p>no</p>";</script><footer>&copy; {n}</footer></body></html>"""
WANT = "Head {n} & more\nFirst {n} line on two rows\nSecond {n} é é &bogus; x\na{n}\nb"


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def texts(spark, data):
    return sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in H.texts_of(frame(spark, data)).collect())


def test_template_goes_and_slots_stay(spark):
    data = [(i, f"http://u:p@Host.example:80/{i}", PAGE.format(n=i)) for i in range(6)]
    for i, (n, text, size) in enumerate(texts(spark, data)):
        assert (n, text, size) == (i, WANT.format(n=i), len(WANT.format(n=i)))


def test_article_keeps_what_all_pages_share(spark):
    page = "<body><div>Slogan</div><article><h1>Same</h1><p>Shared line.</p><p>Own {n}.</p></article><aside>x{n}</aside>"
    data = [(i, "http://h/", page.format(n=i)) for i in range(5)]
    assert [t for _, t, _ in texts(spark, data)] == [f"Same\nShared line.\nOwn {i}." for i in range(5)]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    data = [
        (1, "http://a/", None), (2, "http://a/", ""), (3, None, "<p>alone &lt;b&gt;"), (4, "no url", "text only < 3 & > 2"), (5, "http://c/", "<p>cut <b off"),
        (6, "http://c/", "<article><p>" + "word " * 50_000 + "</article>"), (7, "http://d/", "<!-- open"), (None, "http://e/", "<p>x</p>"), (None, "http://e/", "<p>x</p>"),
        (8, "http://f/", "<div></div>" * 5 + "<p>a<p>b"), (9, "http://g/", deep), (10, "http://h/", "<script>never closed <p>x"),
    ]
    got = {n: t for n, t, _ in texts(spark, data)}
    assert got[1] == got[2] == got[7] == got[10] == ""
    assert got[3] == "alone <b>" and got[4] == "text only < 3 & > 2" and got[5] == "cut"
    assert got[6] == " ".join(["word"] * 50_000) and got[-1] == "x" and got[8] == "a\nb" and got[9] == "deep"


def test_empty_table_and_clashing_columns(spark):
    assert H.texts_of(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "http://a/", "<p>x")]).selectExpr("*", "'h' AS host", "'w' AS wrapper", "1 AS main_text")
    row = H.extracted(df).first()
    assert (row.host, row.wrapper, row.main_text) == ("h", "w", "x")


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    data = [(i, f"http://h{i % 3}/", PAGE.format(n=i)) for i in range(9)]
    first = texts(spark, data)
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert texts(spark, data) == first


def test_tree_matching_counts_pairs():
    one, two = (H.outline(H.parse(x)) for x in ("<div><p>a</p><ul><li>b</ul></div>", "<div><h1>t</h1><p>c</p><p>d</p></div>"))
    assert H.tree_match(one, two) == 3  # root, div, p
    assert H.matching(one["c"][0]["c"], two["c"][0]["c"]) == [(0, 1)]


@pytest.mark.parametrize("html", ["<p><b>x<br><p>y", "<ul><li>x<li>y</ul>", "<table><tr><td>x<td>y</table>", "<div>x<div>y</div></div>"])
def test_missing_end_tags(html):
    assert H.main_text(html, None) == "x\ny"


def test_copies_count_once_and_template_is_on_most_pages(spark):
    """What only copies of one page have, or a few of many pages, is no template."""
    page = "<body><div class=top>Slogan</div><div class=content><p>Own {n}.</p>{more}<h6>Contact us</h6></div>{beside}</body>"
    data = [(i, "http://h/", page.format(n=i, more="<h2>Introduction</h2>" if i < 3 else "", beside="")) for i in range(9)]
    copied = page.format(n=50, more="<ul><li>Only here</ul>", beside="<div class=more><p>Beside.</p></div>")
    data += [(i, "http://h/", copied) for i in range(50, 54)]
    got = {n: t for n, t, _ in texts(spark, data)}
    assert all(got[i] == (f"Own {i}.\nIntroduction" if i < 3 else f"Own {i}.") for i in range(9))
    assert all(got[i] == "Own 50.\nOnly here\nBeside." for i in range(50, 54))


def test_copies_of_one_page_keep_its_text(spark):
    data = [(i, "http://h/", "<div class=a><p>x</div><div class=b><p>y</div>") for i in range(5)]
    assert [t for _, t, _ in texts(spark, data)] == ["x\ny"] * 5


@pytest.mark.parametrize("page", [
    "<body class='home no-sidebar'><p>x</p><p>y</p></body>", "<body class='single comments-open'><p>x</p><p>y</p></body>", "<div class='layout with-sidebar'><p>x</p><p>y</p></div>",
    "<article class='post related-42'><p>x</p><p>y</p></article>", "<article><p>x</p><section id='privacy-notice'><p>y</p></section></article>", "<article><h1 class='post-header'>x</h1><p>y</p></article>",
    "<article class='comments'><h1 class='header'>x</h1><p>y</p></article>",
])
def test_names_that_merely_hold_a_word_lose_no_text(page):
    assert H.main_text(page, None) == "x\ny"


@pytest.mark.parametrize("page", [
    "<article><p>x <span class='ad'>buy <span>now</span> this</span></p><p>y</p></article>", "<article><p>x</p><p hidden>z</p><div style='display: none'>z</div><p>y</p></article>",
    "<p>x<p>y<div class='site-footer'>z</div><div class='comment-list'>z</div><div class='ad'>z</div>", "<p>x</p><i class=ad>z<p>y</p>",
])
def test_what_whole_names_and_hidden_elements_leave_out(page):
    assert H.main_text(page, None) == "x\ny"


@pytest.mark.parametrize("depth", [0, 20, 148, 149, 150, 200, 5000])
def test_depth_changes_nothing(depth):
    page = "<div>" * depth + "<nav><div><p>Menu</p></div></nav><article><p>Text.</p><div class=ad><div>Ad</div></div><p>More.</p></article><footer><p>Foot</p></footer>" + "</div>" * depth
    assert H.main_text(page, None) == "Text.\nMore."


def test_a_wrapper_is_as_large_as_the_layout():
    """Pages with ids of their own and very many children."""
    def page(i):
        return f"<body><div class='top'>Slogan</div><div class='post-{i}' id='post-{i}'>" + "".join(f"<h2>H{i} {k}</h2><p>P{i} {k}</p>" for k in range(i % 90)) + f"<p>Own {i}</p></div></body>"

    made = H._alone(H.outline(H.parse(page(0))))
    sizes = []
    for i in range(1, 2000):
        made = H.merge(made, H._alone(H.outline(H.parse(page(i)))))
        sizes.append(len(H.json.dumps(made)))
    assert sizes[-1] < 2 * sizes[200] and sizes[-1] < 3000
    wrapper = H.json.dumps(made | {"way": H.region_of(made)})
    assert H.main_text(page(1), wrapper) == "H1 0\nP1 0\nOwn 1"


def test_hosts_without_telling_names(spark):
    page = "<body><div><span>Site slogan</span></div><div class=a><ul><li>One<li>Two</ul></div><div class=b><h2>Head {n}</h2><p>Own {n}.</p><p>Share this text</p></div><div class=c>All rights</div></body>"
    data = [(i, "http://h/", page.format(n=i)) for i in range(8)]
    assert [t for _, t, _ in texts(spark, data)] == [f"Head {i}\nOwn {i}.\nShare this text" for i in range(8)]
