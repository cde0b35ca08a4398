"""Pages whose article elements hold less than the whole main text."""

from bitquarry.llm import htmltext


def test_text_outside_teasers_is_kept():
    story = "The old bridge was closed for repairs after the flood and will open again in the spring. " * 5
    page = f"<html><body><div><p>{story}</p></div><p class='menu'>Home</p><article><h2>More news</h2><p>A short teaser about boats</p></article></body></html>"
    assert htmltext.main_text(page) == f"{story.strip()} More news A short teaser about boats"


def test_short_lines_outside_the_article_are_left_out():
    story = "The old bridge was closed for repairs after the flood and will open again in the spring. " * 5
    page = f"<html><body><p>Home</p><nav>Menu</nav><nav>Menu</nav><article><p>{story}</p></article></body></html>"
    assert htmltext.main_text(page) == story.strip()
