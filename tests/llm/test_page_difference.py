import random

from msgflow.llm import neighbours
from msgflow.llm.page_difference import BOILERPLATE, MAIN, OPEN, common_lines, extracted, lines, main_text


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(3000):
        letters = "abcdefgh"[:rng.choice([2, 3, 8])]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(10))] for _ in range(2))
        found = [a[i] for i in sorted(common_lines(a, b))]
        rest = iter(b)
        assert len(found) == longest(a, b) and all(x in rest for x in found)


def test_lines_of_a_page():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
      <nav><ul><li>Home<li>About</ul></nav><div class="side-bar sidebar">no</div><p>open &amp; free</p>
      <article><h1>Ti<b>t</b>le</h1><p>one<br>two  &nbsp;three<p>four <!-- no --> five<aside>no</aside>
      <div id=comments><p>no</p></div><form>no</form>six</article><footer>&copy; me</footer></body>"""
    assert [x for x in lines(page) if x[1] != BOILERPLATE] == [
        ("open & free", OPEN), ("Title", MAIN), ("one", MAIN), ("two three", MAIN), ("four five", MAIN), ("six", MAIN)]
    assert lines("") == [] and lines("plain text") == [("plain text", OPEN)] and lines("a < b <c") == [("a < b <c", OPEN)]
    assert lines("<p>x<script>never closed") == [("x", OPEN)]


def test_template_lines_go_and_copies_stay():
    own = [("menu a", OPEN), ("the story of one", OPEN), ("contact", OPEN)]
    other = [("menu a", OPEN), ("another long story", OPEN), ("contact", OPEN)]
    assert main_text(own, [other]) == "the story of one"
    assert main_text(own, [own]) == "menu a the story of one contact"
    assert main_text([("x", MAIN), ("y", OPEN)], []) == "x"


def test_pages_of_a_host_in_many_buckets(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i:03d}?q=1", f"<div>menu {i % 2}</div><div>story {i} is told here</div><div>end {i % 2}</div>")
            for i in range(60)] + [(60, None, None), (61, "http://solo.example/", "<p>only</p>"), (62, "", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    real = neighbours.with_neighbours
    from msgflow.llm import page_difference
    monkeypatch.setattr(page_difference, "with_neighbours", lambda *a, **k: real(*a, **k | {"rows_per_bucket": 7}))
    got = {r.page_id: r for r in extracted(df).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:60]:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, f"story {i} is told here", len(f"story {i} is told here"))
    assert [got[i].text for i in (60, 61, 62)] == ["", "only", ""] and got[60].url is None
    assert extracted(df.limit(0)).collect() == []


def test_open_lines_of_pages_with_main_lines_are_differenced():
    """Lines outside article and main are main text if no neighbour shares them, in page order."""
    def page(n, *marked):
        return [("menu", OPEN), (f"headline {n}", OPEN), *[(x, MAIN) for x in marked], (f"body {n} is told here at length", OPEN), ("contact", OPEN)]

    assert main_text(page(1, "teaser"), [page(2, "teaser")]) == "headline 1 teaser body 1 is told here at length"
    article = [("menu", OPEN), ("a long story " * 9, MAIN), ("contact", OPEN)]
    assert main_text(article, [page(2, "teaser")]) == "a long story " * 9
    # Copies and missing neighbours decide nothing; then the larger part does.
    for near in ([], [article]):
        assert main_text(article, near) == "a long story " * 9
    assert main_text(page(1, "title"), []) == "menu headline 1 title body 1 is told here at length contact"


def test_parts_outside_the_article_of_a_table(spark):
    rows = [(i, f"http://h.example/{i:03d}", f"<div>menu</div><h1>headline {i}</h1><main><h2>teaser</h2></main><p>body {i} is told here</p><div>end</div>")
            for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extracted(df).collect()} == {i: f"headline {i} teaser body {i} is told here" for i, _, _ in rows}


def test_names_that_only_hold_a_word_do_not_close_a_part():
    for tag in ("article class='post has-sidebar'", "main class=no-header", "article id='withAds'"):
        assert lines(f"<{tag}>text</{tag.split()[0]}>") == [("text", MAIN)], tag
    for tag in ('div class="content with-ads"', "div class=elementor-widget-container", "article class='promo'"):
        assert lines(f"<{tag}>text</{tag.split()[0]}>") == [("text", OPEN)], tag
    assert lines('<div class="widget"><p>no</p><article><p>text</p><div class="share">no</div></article></div><p>open</p>') == [
        ("no", BOILERPLATE), ("text", OPEN), ("no", BOILERPLATE), ("open", OPEN)]
    assert lines('<article><div class="social-links">doubt</div>text <b class="ad-note">one</b></article>') == [("doubt", OPEN), ("text one", MAIN)]
    for page in ("<div id=comments><article>no</article></div>", "<nav><main>no</main></nav>", '<div role="search">no</div>',
                 '<div class="main Sidebar">no</div>'):
        assert lines(page) == [("no", BOILERPLATE)], page
