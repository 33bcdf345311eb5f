"""Main text of pages in several layouts."""

import html
import re
import time

from snaplake.llm import html_blocks, queries

SF = "/root/testdata/sf0.001"
TREE = html_blocks.grow_tree(html_blocks.MARKED[:, :-1], html_blocks.MARKED[:, -1])
PROSE = "This paragraph of the article is long enough to be taken for prose by anyone who reads it, and it has no links."


def text(page):
    return html_blocks.main_text(page, TREE)[0]


def test_tree_agrees_with_its_table():
    found = html_blocks.classify(TREE, html_blocks.MARKED[:, :-1])
    assert (found == html_blocks.MARKED[:, -1]).all()


def test_article_among_everything_else():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{x}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. <button>OK</button></div><!-- <p>hidden {PROSE}</p> -->
    <div id="content"><div class="post"><h2>A &amp; B &copy</h2><p>Short.<p>Some <b>bo</b>ld\n  text&nbsp;here.
    <ul><li>Item one<li>Item two</ul><form><input> {PROSE} <select><option>a</select></form>
    <div class="ad">{PROSE}</div><span class="promo">Buy</span><script>var a = "</p><p>x";</script><p>{PROSE}</p></div>
    <div id="comments"><h3>3 comments</h3><article class="comment"><p>{PROSE}</p></article></div></div>
    <aside><p>{PROSE}</p></aside><footer><p>{PROSE}</p></footer><script>unclosed {PROSE}"""
    assert text(page) == f"A & B © Short. Some bold text here. Item one Item two {PROSE}"


def test_page_without_hints():
    page = f"""<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>Heading of it</h1><p>{PROSE}</p><p>Ok.</p><p>{PROSE}</p>
    <div><a>About</a> <a>Contact</a></div><div>Copyright 2020</div>"""
    assert text(page) == f"Heading of it {PROSE} Ok. {PROSE}"


def test_odd_pages():
    assert text("") == "" and text("   ") == ""
    assert text("plain &lt;text&gt;") == "plain <text>"
    assert text("<p>cut off <a href='") == "cut off"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<script>only</script>") == ""
    many = "<article>" + "<p><b>word<br>" * 20000 + "</article>"
    assert text(many) == " ".join(["word"] * 20000)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_html_blocks(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]["html"] or ""
        inner = re.search(r"<article>(.*)</article>", page, re.S)
        body = re.sub(r"</?b>", "", inner[1]) if inner else ""
        wanted = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body)).split())
        assert r["text"] == wanted and r["n_chars"] == len(wanted) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x</p>", 5), (2, "u", "", 5), (2, "u", "", 5)],
                                  "page_id long, url string, html string, text int")
    rows = html_blocks.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in rows) == [("1", ""), ("2", ""), ("2", ""), ("None", "x")]
    assert html_blocks.extract(pages.limit(0)).count() == 0


def features_by_force(found):
    words, density = [0], [0.0]
    for t, linked, *_ in found:
        words.append(len(t.split()))
        density.append(min(1.0, linked / max(1, words[-1])))
    words, density = words + [0], density + [0.0]
    return [[words[i], density[i], words[i + 1], density[i + 1], words[i + 2], density[i + 2], *found[i][2:]] for i in range(len(found))]


def test_features_by_force():
    page = f"<nav><a href=1>One two</a> three</nav><article><h1>Four</h1><p>{PROSE} <a>link in it</a></p><ul><li><a>x</a></ul></article>"
    found = html_blocks.blocks(page)
    assert [b[0] for b in found][:2] == ["One two three", "Four"]
    assert html_blocks.block_features(found).tolist() == features_by_force(found)


def test_broken_quotes_stay_linear():
    import time

    def seconds(n):
        start = time.process_time()
        for piece in ('<a b="', "<script x='", "</script", "<p class='a\"", "<!-- "):
            html_blocks.main_text(f"<p>{PROSE}</p>" + piece * n + ">", TREE)
        return time.process_time() - start

    assert text(f"<p>{PROSE}</p>" + '<a b="' * 3).startswith(PROSE)
    seconds(500)
    assert seconds(40_000) < 60 * max(seconds(2_000), 0.005)
