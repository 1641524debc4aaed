import math

import numpy as np
from runloom.llm import dedup_embeddings as de
from runloom.llm import html_main
from shared_values import SF_SMALL


def test_near_duplicates_are_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    for i in range(100, 260):
        x[i] = x[i % 20] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5])
    x[260:270] = x[3]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.9) & ~np.eye(300, dtype=bool)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.array([min(comp[i], comp[linked[i]].min(initial=300)) for i in range(300)])
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900, None, ""), (901, [], ""), (902, [0.0] * 16, ""), (903, [math.nan] * 16, ""), (904, [None] + [1.0] * 15, ""), (905, [1.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in de.near_duplicates(frame, block=64).collect()}
    assert len(got) == 306
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), comp[i], comp[i] == i) for i in range(300))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert de.near_duplicates(frame.where("false")).count() == 0


def test_blocks_of_a_page():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use <b>coo</b>kies</div>
      <main><article class="post"><h1>T</h1><!-- no --><p>a &lt; b&nbsp; c<br>d</p><script>x("</p>")</script><div class="comments"><p>nice!</p></div>
      <ul><li>x<li>y</ul><form>q</form></article><aside>s</aside></main><footer>f</footer> trailing <b"""
    assert [t for level, chrome, t in html_main.blocks(page) if level == 3 and not chrome] == ["T", "a < b c d", "x", "y"]


def test_main_text_and_host_boilerplate(spark):
    menu = "<div>Start page and all the topics</div><div>About this site and its authors</div>"
    words = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey", "north south east west up down"]
    rows = [(i, f"http://a.org/{i}", f"<body>{menu}<p>{w} {w[::-1]}</p></body>", "clash") for i, w in enumerate(words)]
    rows += [(10, "http://b.org/1", f"<body>{menu}<p>b</p></body>", ""), (11, None, None, ""), (12, "", "", ""), (0, *rows[0][1:])]
    rows += [(20 + i, f"http://a.org/x{i}", f"<body>{menu}<article><p>The same article on many pages of it</p></article></body>", "") for i in range(4)]
    got = [(r.page_id, r.text) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert sorted(got)[:5] == sorted([(0, f"{words[0]} {words[0][::-1]}")] * 2 + [(i, f"{words[i]} {words[i][::-1]}") for i in (1, 2, 3)])
    assert dict(got)[10].startswith("Start page") and dict(got)[11] == "" and dict(got)[12] == ""
    assert all(dict(got)[20 + i] == "The same article on many pages of it" for i in range(4))


def test_equal_words_with_other_marks_are_judged_apart(spark):
    words = "Hello big world text"
    rows = [(1, "http://c.org/1", f"<div>{words}</div>"), (2, "http://c.org/2", f"<nav>{words}</nav>"), (3, "http://c.org/2", f"<nav>{words}</nav>"), (4, "http://c.org/2", f"<div>{words}</div>")]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: words, 2: "", 3: "", 4: words}


def test_repeats_count_pages_on_hosts_of_any_size(spark):
    notice = "<div>One two three four five six seven</div>"
    rows = [(i, f"http://d.org/{i}", f"<body>{notice if i < 5 else ''}<p>{' '.join(f'w{i}x{k}' for k in range(8))}</p></body>") for i in range(200)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(f"w{i}x{k}" for k in range(8)) for i in range(200))


def test_main_beside_articles_and_headers_of_articles(spark):
    rows = [(1, "http://e.org/1", "<main><h1>Title</h1><p>Story one</p><article class=card><p>Teaser</p></article></main>"),
            (2, "http://e.org/2", "<header>Site</header><article><header><h1>Head</h1></header><p>Text</p><header class=banner>Buy</header></article>"),
            (3, "http://e.org/3", "<main><h1>Title</h1><p>Story one</p><article class=card><p>Another</p></article></main>"),
            (4, "http://e.org/4", "<main><article><p>Teaser</p></article><h1>Title</h1><p>Story one</p></main>")]
    notice = "<p>Please read the rules of this house first</p>"
    rows += [(10 + i, f"http://e.org/n{i}", f"<main>{notice}<article><p>Own words {i}</p></article><p>Beside u{i} v{i} w{i} x{i} y{i} z{i}</p></main>") for i in range(4)]
    rows += [(20, None, "<main><article></article></main>"), (21, None, "<article><article><p>in</p></article><p>out</p></article>")]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title\n\nStory one\n\nTeaser" and got[3] == "Title\n\nStory one\n\nAnother" and got[4] == "Teaser\n\nTitle\n\nStory one"
    assert got[2] == "Head\n\nText" and got[20] == "" and got[21] == "in\n\nout"
    assert [got[10 + i] for i in range(4)] == [f"Own words {i}\n\nBeside u{i} v{i} w{i} x{i} y{i} z{i}" for i in range(4)]


def test_given_articles_against_a_plain_reading(spark):
    """Every given page has one article of its own with nothing foreign in it: its blocks, read by splitting at tags."""
    import html
    import re
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    seen = 0
    for r in pages.collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        if inner is None or re.search(r"<(nav|footer|aside|form|script|style|div|section|header)\b|<!--", inner[1]):
            continue
        parts = re.split(r"(?:</?(?:p|h[1-6]|li|ul|ol|blockquote|pre|table|tr|td|th|dl|dt|dd|figure|figcaption|hr)\b[^>]*>)+", re.sub(r"<br\s*/?>", " ", inner[1]))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x), r.page_id
        seen += 1
    assert seen > 10


def test_boilerplate_inside_marked_articles(spark):
    """What the host prints in most of its articles goes, at any place; what some of them share, short blocks and copies stay."""
    ask = "Subscribe to the paper of this town today"
    share = "A passage that eight of the articles quote alike"

    def story(i, n=20):
        return " ".join(f"w{i}x{k}" for k in range(n))
    page = "<article><p>{}</p><p>{}</p><p>Read more</p><p>{} <b>{}</b> and never miss our news again</p><p>{}</p></article>"
    rows = [(i, f"http://f.org/{i}", page.format(story(i), share if i < 8 else story(100 + i), ask, f"n{i}", story(200 + i))) for i in range(20)]
    rows += [(30 + i, f"http://f.org/m{i}", f"<main><p>Beside {story(300 + i)}</p><article><p>{ask} n and never miss our news again</p><p>{story(400 + i)}</p></article></main>") for i in range(3)]
    rows += [(40, "http://f.org/short", f"<article><p>{ask} n and never miss our news again</p><p>Three more words</p></article>"), (41, *rows[0][1:])]
    rows += [(50 + i, f"http://g.org/{i}", page.format(story(0), share, ask, f"n{i}", f"edit{i}")) for i in range(30)]  # revisions of one article
    rows += [(90 + i, f"http://h.org/{i}", page.format(story(i), share, ask, "n", story(50 + i))) for i in range(9)]  # fewer than LEAST_ARTICLES
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == "\n\n".join([story(i), share if i < 8 else story(100 + i), "Read more", story(200 + i)])
    assert all(got[30 + i] == f"Beside {story(300 + i)}\n\n{story(400 + i)}" for i in range(3))
    assert got[40].startswith(ask) and got[41] == got[0]
    assert all(got[50 + i] == f"{story(0)}\n\n{share}\n\nRead more\n\n{ask} n{i} and never miss our news again\n\nedit{i}" for i in range(30))
    assert all(ask in got[90 + i] and share in got[90 + i] for i in range(9)) and len(got) == len(rows)


def test_all_suffixes_of_marked_articles_are_looked_up(spark, monkeypatch):
    """A repeated run goes wherever it lies in its block, also between words of the article's own; half a block must be covered."""
    ask = "Subscribe to the paper of this town today and never miss our news"

    def story(i, n=40):
        return " ".join(f"w{i}x{k}" for k in range(n))
    page = "<article><p>{}</p><p>by{} {} until{}</p><p>{} {}</p></article>"
    rows = [(i, f"http://i.org/{i}", page.format(story(i), i, ask, i, story(100 + i), ask)) for i in range(24)]
    rows += [(50, *rows[0][1:]), (60, "http://j.org/1", page.format(story(0), 0, ask, 0, story(1), ask))]
    rows += [(70 + i, f"http://k.org/{i}", f"<main><p>Beside {story(300 + i)}</p>{rows[i][2]}</main>") for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (500, 5):  # hosts of one group and of several
        monkeypatch.setattr(html_main, "GROUP", group)
        got = {r.page_id: r.text for r in html_main.main_text(frame).collect()}
        assert all(got[i] == f"{story(i)}\n\n{story(100 + i)} {ask}" for i in range(24)) and got[50] == got[0]
        assert got[60] == f"{story(0)}\n\nby0 {ask} until0\n\n{story(1)} {ask}"
        assert all(got[70 + i] == f"Beside {story(300 + i)}\n\n{story(i)}\n\n{story(100 + i)} {ask}" for i in range(12)) and len(got) == len(rows)
