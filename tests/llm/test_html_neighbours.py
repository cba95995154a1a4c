"""Page differencing: a page without article is compared with its nearest URL, whatever that one's structure."""

from __future__ import annotations

from weftline.llm import html_text

TOP = "<nav><p>Home</p></nav><div>Site of the week</div>"


def test_neighbours_with_an_article(spark):
    story = "<p>The only page of its host without an article, long enough to be no copy of another.</p>"
    pages = [
        (1, "http://h/a/1", f"<body>{TOP}<article><p>First article.</p></article></body>"),
        (2, "http://h/a/2", f"<body>{TOP}{story}</body>"),
        (3, "http://h/a/3", f"<body>{TOP}<article><p>Site of the week</p><p>Third article.</p></article></body>"),
        (4, "http://g/a/1", f"<body>{TOP}{story}</body>"), (5, "http://g/a/2", f"<body>{TOP}{story}<p>A copy.</p></body>"), (6, "http://g/a/3/x", f"<body>{TOP}<p>Something else that is quite long.</p></body>"),
    ]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[2] == "The only page of its host without an article, long enough to be no copy of another."
    assert found[1] == "First article." and found[3] == "Site of the week\nThird article."  # an article keeps what it shares
    assert found[5].split("\n")[-1] == "A copy." and not found[5].startswith("Site")  # its nearest URL is a copy, the next one is not


def test_dropped_blocks_are_cut_as_lines():
    found, settled = html_text.cut(f"<body>{TOP}<p>One <span class='ad'>buy</span> two</p><footer>f<p>g</p></footer></body>")
    assert not settled and [x for x, kept in found if kept] == ["Site of the week", "One two"]
    assert [x for x, kept in found if not kept] == ["Home", "buy", "f", "g"]
