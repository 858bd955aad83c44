import random

import numpy as np
import pytest

from kindred.llm import html_text as H


def page(article, menu="a b", foot="f"):
    items = "".join(f"<li><a href=/{w}>{w}</a>" for w in menu.split())
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul>{items}</ul></nav><!-- c --><div class=\"ad x\">buy</div><article>{article}</article><footer>&copy; {foot}</footer></body></html>"


def test_blocks_and_references():
    got = H.parse(page("<h1>T &amp; x</h1><p>one<br>two  <i>three</i>\n<p><b>four<br><p>five&nbsp;&#8364;</p>"))
    got = [t for t, k in zip(got.texts, got.kinds, strict=True) if k == H.IN_ARTICLE]
    assert got == ["T & x", "one two three", "four", "five €"]


def test_broken_markup():
    lines = lambda x: H.parse(x).texts
    assert lines("<p class=it's>one</p><p>two") == ["one", "two"]
    assert lines('<p>one</p><a href="/cut off') == ["one"]
    assert lines("<p>1 < 2 & 3</p><!-- open") == ["1 < 2 & 3"]
    assert lines('<p title="a > b">x</p>') == ["x"]
    assert lines("<p>a<script>b") == ["a"]
    assert lines("<p>a<script src=/a/>code</script><p>b") == ["a", "b"]
    assert lines("<article><p>one</p><svg><p>two</p></article><p>three") == ["one", "two", "three"]
    assert lines("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><select><option>a</select><p>three") == ["one", "two", "three"]


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "with_share", "show-menu page", "content sidebar"])
def test_class_names_do_not_empty_a_page(name):
    body = f'<body><nav><a href=/>x</a></nav><div class="{name}"><p>the story</p></div><footer>f</footer></body>'
    assert H.main_text(H.parse(body), [])[0] == "the story"
    other = H.parse(body.replace("the story", "another text"))
    assert H.main_text(H.parse(body), [other])[0] == "the story"


def test_nesting_is_linear():
    """Half a megabyte and a megabyte of nested blocks: twice the memory, not four times."""
    import tracemalloc

    def peak(n):
        source = "<div class=a>a" * n
        tracemalloc.start()
        lines = H.parse(source)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(lines.texts) == n
        return most

    assert peak(70_000) < 2.6 * peak(35_000) < 200e6
    deep = "<div>" * 30_000 + "<section>" * 30_000 + "</p></nav>" * 30_000 + "x"
    assert H.parse(deep).texts == ["x"]
    H.main_text(H.parse(deep), [H.parse(deep + "<p>y")])


@pytest.mark.parametrize(
    "furniture",
    [
        "<aside>x</aside>",
        "<header><p>x</header>",
        "<form><p>x</p><input></form>",
        '<div class="cookie-notice"><p>x</p><div>y</div></div>',
        '<section id="comments"><article><p>x</p></article></section>',
        "<div role=navigation>x</div>",
        '<div style="display:none">x</div>',
        "<noscript><p>x</p></noscript>",
        "<script>document.write('<p>x</p>')</script>",
        "<textarea><p>x</textarea>",
        "<ul class=menu><li>x<li>y</ul>",
    ],
)
def test_furniture_inside_the_article(furniture):
    found = H.parse(page(f"<p>before</p>{furniture}<p>after</p>"))
    other = H.parse(page("<p>another story of this site</p>", menu="c d", foot="g"))
    assert H.main_text(found, [])[0] == H.main_text(found, [other])[0] == "before\nafter"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(12))]
        flags = H.common_lines(np.array(a, np.uint64), np.array(b, np.uint64))
        kept = [x for x, f in zip(a, flags, strict=True) if f]
        assert len(kept) == lcs(a, b)
        it = iter(b)
        assert all(x in it for x in kept)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_shared_lines_go_where_no_article_is_marked(spark):
    body = lambda x: f"<html><body><p>Site name</p><p>{x}</p><p>Imprint</p></body></html>"
    rows = [(i, f"http://h.org/a/{i}", body(f"story {i}")) for i in range(6)] + [(9, "http://other.org/a/1", body("alone"))]
    want = {i: f"story {i}" for i in range(6)} | {9: "Site name\nalone\nImprint"}
    for per_range in (2, 500):
        assert texts(H.extract(pages(spark, rows), rows_per_range=per_range)) == want


def test_an_article_at_two_urls_is_kept(spark):
    rows = [(1, "http://h.org/a?x=1", page("<p>same story")), (2, "http://h.org/a?x=2", page("<p>same story", menu="c d"))]
    assert texts(H.extract(pages(spark, rows))) == {1: "same story", 2: "same story"}
    bare = [(i, "http://h.org/a", "<p>one<p>two") for i in (1, 2)]
    assert texts(H.extract(pages(spark, bare))) == {1: "one\ntwo", 2: "one\ntwo"}


def test_a_body_outside_of_article_elements_is_kept(spark):
    """Teasers are article elements, the body is not; the site's own lines go."""
    body = lambda i: f"<p>Site name</p><div><p>body {i} one</p><p>body {i} two</p></div><article>teaser {i}</article><p>Imprint</p>"
    rows = [(i, f"http://h.org/a/{i}", body(i)) for i in range(5)]
    assert texts(H.extract(pages(spark, rows))) == {i: f"body {i} one\nbody {i} two\nteaser {i}" for i in range(5)}


def test_a_near_copy_is_no_neighbour(spark):
    """Two pages of one story, one with a line added, next to others of the site."""
    story = "".join(f"<p>a line of the story, number {k}</p>" for k in range(9))
    body = lambda x: f"<p>Site name</p>{x}<p>Imprint</p>"
    rows = [(1, "http://h.org/a/1", body("<p>first")), (2, "http://h.org/a/2", body(story)), (3, "http://h.org/a/2/x", body(story + "<p>added")), (4, "http://h.org/a/4", body("<p>last"))]
    want = "\n".join(f"a line of the story, number {k}" for k in range(9))
    assert texts(H.extract(pages(spark, rows))) == {1: "first", 2: want, 3: want + "\nadded", 4: "last"}


def test_ranges_do_not_change_results(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        lines = [f"shared {rng.randrange(4)}", f"own {i}", f"shared {rng.randrange(4)}"]
        rows.append((i, f"http://h{i % 3}.org/{'ab'[i % 2]}/{rng.randrange(9)}", "".join(f"<p>{x}</p>" for x in lines)))
    df = pages(spark, rows)
    whole = texts(H.extract(df, rows_per_range=1000))
    assert whole == texts(H.extract(df, rows_per_range=7)) == texts(H.extract(df.repartition(9), rows_per_range=30))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, None, ""), (3, "x", "<"), (4, "::", "<p"), (None, "http://h/", "plain"), (5, "http://h/", "<p>" + "long " * 100_000), (5, "http://h/", "<p>again"), (6, "http://h/", "</p></p></div><li>loose")]
    got = H.extract(pages(spark, rows).selectExpr("*", "'k' AS key", "1 AS range"))
    assert got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0 and by[None]["text"] == "plain" and by[6]["text"] == "loose"
    assert H.extract(pages(spark, [])).count() == 0


def wanted(source):
    """The article of a given page, by a parser of its own."""
    import html as entities
    import re

    blocks = re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in blocks]
    return "\n".join(x for x in blocks if x)


def without_names(source):
    """Every block that names its role is a div without a class."""
    import re

    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|main|nav|footer|aside|header)\b", r"<\1div", source))


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    want = {i: wanted(h) for i, _, h in rows}
    found = H.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in found} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    # The neighbour decides on some lines of nearly every page.
    assert sum(r["n_shared"] > 0 for r in found) > 0.95 * len(found)


def test_differencing_finds_the_article_where_no_tag_names_it(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    want = {i: wanted(h) for i, _, h in rows}
    renamed = [(i, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, h in rows]
    assert texts(H.extract(pages(spark, renamed))) == want
    bare = [(i, u, without_names(h)) for i, u, h in rows]
    got = texts(H.extract(pages(spark, bare)))
    assert sum(got[i] == want[i] for i in want) > 0.85 * len(want)
    alone = texts(H.extract(pages(spark, [(i, f"http://host{i}/", h) for i, _, h in bare])))
    assert not any(alone[i] == want[i] for i in want)


def test_ids_of_other_types(spark):
    rows = spark.createDataFrame([("a", "http://h/1", "<p>x"), (None, "http://h/2", "<p>y")], "page_id string, url string, html string")
    assert texts(H.extract(rows)) == {"a": "x", None: "y"}


def test_a_slot_of_the_template_goes(spark):
    """Blocks named by nothing: a slot filled anew on each page goes, a block that only one page has stays."""
    body = lambda i: f"<div><a href=/>m{i}</a></div><div><p>{'long story ' * 9}{i}</p></div><div>ad {i}</div>" + ("<section><p>postscript</section>" if i == 3 else "")
    rows = [(i, f"http://h.org/a/{i}", body(i)) for i in range(6)]
    want = {i: "long story " * 9 + str(i) + ("\npostscript" if i == 3 else "") for i in range(6)}
    assert texts(H.extract(pages(spark, rows))) == want
