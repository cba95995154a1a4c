"""Page differencing on pages with an article: containers whose names may mean an article's part or a template's slot."""

from __future__ import annotations

from weftline.llm import html_text

SLOT = "<div class='social-club'><p>Join {0}</p><p>and {0}</p></div>"


def page(i, extra=""):
    return f"<body><nav>Home</nav><article><h1>Story {i}</h1><p>Text of story {i}, long enough to be no copy of another story at all, not even with its slot.</p>{extra}<p>Shared words.</p></article></body>"


def text(*more, i=0):
    return "\n".join([f"Story {i}", f"Text of story {i}, long enough to be no copy of another story at all, not even with its slot.", *more, "Shared words."])


def test_everyday_words_in_an_article(spark):
    probe = "<article><p>Intro</p><p class='share-price'>Five</p><div class='related-work'>Others <b>did</b><div>it</div></div><div id='notice-period'>Long</div><p>End</p></article>"
    sure = "<article><p>Intro</p><div class='ad-slot'>a</div><div class='social-links'>b</div><div class='share'>c</div><div class='cookie-box x'>d</div><p class='comment-17'>e</p><p>End</p></article>"
    pages = [
        (1, "http://a/x", probe), (2, "http://b/x", sure),
        *[(10 + i, f"http://h/n/{i}", page(i, SLOT.format(f"club {i}") + ("<p class='share-price'>Six</p>" if i == 2 else ""))) for i in range(4)],
        (20, "http://g/n/1", page(0, "<p class='share-price'>Six<p>Next")), (21, "http://g/n/2", page(1)),
    ]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[1] == "Intro\nFive\nOthers did\nit\nLong\nEnd" and found[2] == "Intro\nEnd"
    # the slot is on each page of the host, with other words; what pages have by themselves stays, and so do lines that an article shares
    assert [found[10 + i] for i in range(4)] == [text(i=0), text(i=1), text("Six", i=2), text(i=3)]
    assert found[20] == text("Six", "Next", i=0) and found[21] == text(i=1)
