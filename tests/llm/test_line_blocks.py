"""Line blocks decide what pages without hints keep."""

import re

import pyarrow.parquet as pq

from bitquarry.llm import htmltext

P = "This is a paragraph of prose, which goes on for long enough to be taken for the main text of a page."
MENU = "<div><a href='/a'>Home</a> | <a href='/b'>News</a> | <a href='/c'>Sport</a></div><ul><li>Home</li><li>About us</li><li>Contact</li><li>Imprint</li></ul>"


def page(body):
    return f"<html><body>{MENU}{body}<p>© 2024 Example Ltd. All rights reserved.</p></body></html>"


def test_unmarked_page_loses_menus_and_notices():
    assert htmltext.main_text(page(f"<p>{P}</p><p>{P}</p><p>Short one.</p><p>{P}</p>")) == f"{P} {P} Short one. {P}"


def test_links_have_no_size():
    links = "".join(f"<p><a href='/{k}'>A long link text that says where it goes to, number {k}</a></p>" for k in range(8))
    assert htmltext.main_text(f"<body>{links}<h2>Title</h2><p>{P}</p>{links}</body>") == f"Title {P}"
    inside = f"<body><p>{P}</p><p><a href='/x'>One link</a></p><p>{P}</p></body>"
    assert htmltext.main_text(inside) == f"{P} One link {P}"


def test_window_and_threshold_decide():
    far = "<hr>".join(["<p>Note. </p>"] + ["<nav>m</nav>"] * 3)
    body = f"<body>{far}<p>{P}</p><p>{P}</p></body>"
    assert htmltext.main_text(body) == f"{P} {P}"
    assert htmltext.main_text(body, threshold=5) == f"Note. {P} {P}"
    lead = "<body>" + "".join(f"<p>item {k}</p>" for k in range(6)) + f"<p>{P}</p></body>"
    assert htmltext.main_text(lead) == P
    assert htmltext.main_text(lead, window=7, threshold=8) != P


def test_table_pages_without_their_article_marks():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    same = other = 0
    for r in rows:
        marked = htmltext.main_text(r["html"])
        stripped = re.sub("</?article>", "", r["html"])
        same += htmltext.main_text(stripped) == marked
        # A threshold that only the fullest windows reach gives other texts.
        other += htmltext.main_text(stripped, 3, 10**9) != marked
    assert same >= 0.97 * len(rows) and other > 0


def test_brute_force_of_marked_pages():
    """On the table's pages, whose form is known, the main text is the article's without tags."""
    import html

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        body = re.search("<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", body)))
        assert htmltext.main_text(r["html"]) == " ".join(want.split())


def test_awkward_pages():
    assert htmltext.main_text("") == "" and htmltext.main_text("<nav>a</nav>") == "" and htmltext.main_text("<p></p><br>") == ""
    assert htmltext.main_text("<a href='/x'>only a link</a>") == ""
    # An unclosed link ends with its line.
    assert htmltext.main_text(f"<p><a href='/x'>open<p>{P}</p>") == P
    assert htmltext.main_text(f"<article><p>{P}</p>" + "<div>" * 5000 + "deep") == f"{P} deep"
