import re
from html import unescape

from promptloom.llm import webtext as W


def extract(*pages):
    return W.extract(list(pages), W.train())


def test_generated_pages_held_out():
    right = 0
    for html in W.generated(60, 99):
        page = W.Page(html)
        keep = [False] * len(page.tag)
        for piece in page.pieces:
            if piece and piece[1].startswith("\ue000"):
                k = piece[0]
                while k >= 0:
                    keep[k], k = True, page.parent[k]
        right += W.main_text(page, keep).replace("\ue000", "") == extract(html.replace("\ue000", ""))[0]
    assert right >= 54


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in W.main_texts(pages, W.train()).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(unescape(re.sub(r"</?(?:p|br|h1)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


ARTICLE = "<article><h1>A title of the page</h1><p>First &amp; second, with <b>bold</b>er words and a lot of text here.</p><p>Another\n\n paragraph &#x41;, which goes on for a while, and ends.</p></article>"


def test_decoding_and_white_space():
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>{ARTICLE}<footer>&copy; me</footer></body></html>"
    assert extract(page)[0] == "A title of the page First & second, with bolder words and a lot of text here. Another paragraph A, which goes on for a while, and ends."


def test_contradictions_are_impossible():
    for html in W.generated(20, 5):
        page = W.Page(html)
        keep = W.decode(page, W.log_odds(W.train(), W.features(page)).tolist())
        assert all(keep[page.parent[k]] for k in range(1, len(keep)) if keep[k])


def test_broken_pages():
    pages = [None, "", "<", "</p>", "<p", "plain text", "<!-- open", "<script>never closed", "<div " + "a" * 5000, "<p>" * 3000 + "deep", '<a href="x>y</a>', "<article><p>cut off here, in the mid", "&#xD800; &bogus; &lt;"]
    assert len(extract(*pages)) == len(pages)
    assert extract(None, "") == ["", ""]


def test_rows_pass_through(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ARTICLE), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars", "'z' AS __html")
    got = W.main_texts(df, W.train()).collect()
    assert sorted((str(r.page_id), r.n_chars > 0) for r in got) == [("1", False), ("1", False), ("2", False), ("None", True)]
    assert W.main_texts(df.limit(0), W.train()).collect() == []


def test_quoted_values_of_any_length():
    for quote in "\"'":
        value = "<p>" + "hidden words > " * 400 + "</p>"
        page = W.Page(f"<body><div data-x={quote}{value}{quote} class='sidebar'>shown</div><p>more</p></body>")
        assert [t for _, t, _ in filter(None, page.pieces)] == ["shown", "more"]
        assert page.tag.count("div") == 1 and page.tag.count("p") == 1 and page.kinds[page.tag.index("div")]


def test_unclosed_quotes_cost_linear_time():
    import time

    start = time.perf_counter()
    ends = W.TagEnds("<x a='" + '<y b="1" ' * 200_000)
    assert not any(ends.after(k) for k in range(2, 1_800_000, 9)) and time.perf_counter() - start < 20


def test_deep_and_stray_tags_take_linear_time():
    import time

    for make in (lambda n: "<x-a>" * n + "text", lambda n: "<b>" * n + "</i>" * n + "text", lambda n: "<div>" * n + "<p>text", lambda n: "<p>" * n + "</x-y>" * n, lambda n: "<li><x-b>" * n + "</li>" * n):
        took = []
        for n in (20_000, 200_000):
            began = time.perf_counter()
            W.Page(make(n))
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * max(took[0], 0.05)


def test_deep_page_is_extracted():
    text = "words of the article that go on for a while, with commas, and stops. " * 20
    page = "<html><body>" + "<div>" * 20_000 + f"<article><p>{text}</p></article>" + "</div>" * 20_000 + "</body></html>"
    assert W.extract([page], W.train()) == [text.strip()]
