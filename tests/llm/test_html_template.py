import re
from html import unescape

from gazette.llm import html_template as H

SF = "/root/testdata/sf0.001"


def article_text(html):
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(x for x in parts if x)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def page(i, extra=""):
    return (f"<html><head><title>t{i}</title></head><body><header><h1>Site name</h1></header><div id='cookie-notice'>We use "
            f"cookies</div><ul class='menu'><li><a href=/>Home</a></ul><div class='post'><h1>Title {i}</h1><p>Body &amp; soul{i} "
            f"<a href=x>link</a> goes on here</p><div>Subscribe to our daily letter now</div><p>unclosed{i}<br>line "
            f"<span class='ad'>buy</span> end{i}{extra}</div><div class='links'><a>aaa {i}</a><a>bbb {i}</a></div>"
            f"<div class='comments'><p>nice {i}</p></div><script>var a='<p>no</p>'</script><footer>foot</footer></body></html>")


def test_template_text_and_noise_go(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {i: f"Title {i}\nBody & soul{i} link goes on here\nunclosed{i}\nline end{i}" for i in range(8)}


def test_few_pages_have_no_template(spark):
    df = spark.createDataFrame([(1, "http://h.example/1", page(1))], "page_id long, url string, html string")
    assert "Subscribe to our daily letter now" in H.extract(df).first().text


def test_edges(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://x/", "<p>a<"), (3, "http://x/", "<p>a<"), (None, "http://x/", "plain &lt; text"),
            (5, "http://x/", "<div class=ad>never closed" + "<p>word " * 20_000), (6, "http://x/", "</div></p>tail<!-- open"),
            (7, "http://x/", "<article>in</div><p>still</article>out")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS _html")
    got = {(r.page_id, r.url): r.text for r in H.extract(df).collect()}
    assert H.extract(df).count() == len(rows)
    assert got[1, None] == "" and got[2, "no url"] == "" and got[None, "http://x/"] == "plain < text"
    assert got[5, "http://x/"] == "" and got[6, "http://x/"] == "tail" and got[7, "http://x/"] == "in\nstill"
    assert H.extract(df.limit(0)).count() == 0


def test_join_by_host_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, H.extract(df).collect())) == want


def texts(spark, htmls):
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(htmls)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_copies_are_no_template(spark):
    nav = "<div>Fixed words of the site</div><div>and more</div><div>and last</div>"
    for tag in ("article", "div"):
        one = [f"<body>{nav}<{tag}><h1>Copy</h1><p>first line</p><p>second</p><p>third</p></{tag}><a>link {i}</a></body>" for i in range(12)]
        other = [f"<body>{nav}<{tag}><h1>T{i}</h1><p>own {i} text of it</p></{tag}></body>" for i in range(8)]
        got = texts(spark, one + other)
        assert got[:12] == ["Copy\nfirst line\nsecond\nthird"] * 12
        assert got[12:] == [f"T{i}\nown {i} text of it" for i in range(8)]


def test_fixed_strings_and_links_in_the_article_stay(spark):
    htmls = [f"<body><div>Site words</div><article><h2>Summary</h2><p>By our staff</p><p>own text {i}</p><h2>Sources</h2>"
             f"<ul><li><a href=x>paper number {i}</a></ul></article></body>" for i in range(8)]
    assert texts(spark, htmls) == [f"Summary\nBy our staff\nown text {i}\nSources\npaper number {i}" for i in range(8)]


def test_fixed_teasers_are_no_article(spark):
    teaser = "<article>one</article><article>two</article><article>three</article>"
    assert texts(spark, [f"<body><div>the text of page {i}, long enough</div>{teaser}</body>" for i in range(8)]) == [
        f"the text of page {i}, long enough" for i in range(8)]


def test_names_of_wrappers_do_not_exclude_the_page():
    read = lambda html: [t for _, out, _, t, _ in H.Page(html).blocks if not out]
    noise = "<div class='sidebar'>side words</div><div class='comments'><article class='comment'>a reader's long remark</article></div>"
    for names in ("single has-sidebar", "no-sidebar", "layout sidebar-right", "post type-post comments-open", "page search-results",
                  "site sticky-header"):
        for a, b in (("<body X>", "</body>"), ("<main X>", "</main>"), ("<article X>", "</article>"), ("<div X><article>", "</article></div>"),
                     ("<div X><div X><main>", "</main></div></div>"), ("<div X>", "</div>"), ("<div class='articleBody X'>", "</div>")):
            a = a.replace("'articleBody X'", f"'articleBody {names}'").replace("X", f"class='{names}'")
            assert read(f"<html class='{names}'>{a}<h1>Title</h1><p>the text of the page</p>{b}{noise}</html>") == [
                "Title", "the text of the page"], (a, names)
    assert read(f"<div class='has-sidebar'><div>the text of the page</div>{noise}</div>") == ["the text of the page"]
    assert read("<article>the long text<section class='related-posts'><article>card</article></section></article>") == ["the long text"]
    assert read("<article class='comment'>a</article><article class='post comments-open'>b</article>") == ["b"]
    assert read("<div class='comments'>only readers</div><div class='share'><p>x</p></div>") == []


def test_pages_in_named_wrappers(spark):
    htmls = [f"<body class='single has-sidebar'><article class='post comments-open'><p>text {i}</p></article></body>" for i in range(6)]
    assert texts(spark, htmls) == [f"text {i}" for i in range(6)]


def test_notice_on_part_of_the_pages(spark):
    notice = "<div>We have moved to a new building in town</div>"
    htmls = [f"<body>{notice if i % 5 < 3 else ''}<div><p>text of page {i}</p></div></body>" for i in range(20)]
    assert texts(spark, htmls) == [f"text of page {i}" for i in range(20)]


def test_vectors_equal_plain_occurrence_vectors(spark):
    """Template tokens of a host without articles against classes of plainly written vectors."""
    htmls = [page(i, " and more" if i % 3 else "") for i in range(9)]
    rows = [(f"h{i % 2}", x) for i, x in enumerate(htmls * 2)]
    got = {r.host: set(r.tokens or ()) for r in H.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    for host in ("h0", "h1"):
        bodies = {}
        for h, html in rows:
            if h == host:
                p = H.Page(html)
                bodies.setdefault(H.body_key(p), H._tokens(p))
        every = {t for own in bodies.values() for t in own}
        classes = {}
        for t in every:
            classes.setdefault(tuple(own.get(t, (0, 0))[0] for own in bodies.values()), []).append(t)
        want = set()
        for vector, tokens in classes.items():
            on = sum(n > 0 for n in vector)
            words = sum(sum(own[t][1] for own in bodies.values() if t in own) / on for t in tokens)
            if on >= H.MIN_PAGES and on >= H.MIN_SHARE * len(bodies) and words >= H.MIN_CLASS:
                want.update(tokens)
        assert got[host] == want and len(want) > 20


def test_long_names_stay_apart():
    a, b = ("x" * 70 + "a"), ("x" * 70 + "b")
    paths = [path for path, *_ in H.Page(f"<div class='{a}'>one</div><div class='{b}'>two</div><div class='{a}'>three</div>").blocks]
    assert paths[0] == paths[2] != paths[1] and all(len(p) < 80 for p in paths)
