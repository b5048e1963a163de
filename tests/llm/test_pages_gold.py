"""Whole main texts of pages of many layouts, on their own and by a host's votes."""

from __future__ import annotations

import pytest

from tollgate.llm import html_paths

LONG = "A paragraph of the story that is long enough to be running text, and then a little more of it."
NEXT = "Another paragraph of the same story, which goes on for some time before it comes to its end."
LEAD = "The lead says in one sentence what the story is about."
MENU = "<nav><ul>" + "".join(f"<li><a href=/{k}>Section {k}</a>" for k in range(12)) + "</ul></nav>"
FOOT = "<footer><p>&copy; 2024 The paper, all rights reserved, and some more words in the footer.</p></footer>"
LINKS = "<div class=box>" + "".join(f"<p><a href=/{k}>Headline of story number {k} to read next</a></p>" for k in range(6)) + "</div>"
COMMENTS = "<div class=thread>" + "".join(f"<div class=post><p>Reader {k} has an opinion on this and tells it at length, again and again and again.</p></div>"
                                          for k in range(6)) + "</div>"
SHORT = "A short article of one paragraph that is not nearly as long as what its readers say about it."

GOLD = {
    "title beside content in an article": (
        f"{MENU}<article><h1>Title</h1><div class=content><p>{LONG}</p><p>{NEXT}</p></div></article>{FOOT}", ["Title", LONG, NEXT]),
    "lead and story in the body": (f"<div class=lead><p>{LEAD}</p></div><div class=story><p>{LONG}</p><p>{NEXT}</p></div>", [LEAD, LONG, NEXT]),
    "two parts": (f"{MENU}<div class=c><p>{LONG}</p><p>{NEXT}</p></div><div class=d><p>{NEXT}</p></div>{FOOT}", [LONG, NEXT, NEXT]),
    "article shorter than its thread": (f"<article><p>{SHORT}</p></article>{COMMENTS}", [SHORT]),
    "thread inside main, beside the article": (f"<main><article><h1>T</h1><p>{SHORT}</p></article>{COMMENTS}</main>", ["T", SHORT]),
    "listing of posts without an article": (
        f"<div class=posts><div class=post><p>{LONG}</p></div><div class=post><p>{NEXT}</p></div></div>", [LONG, NEXT]),
    "heading above the content": (f"{MENU}<h1>Title</h1><div class=content><p>{LONG}</p></div>{FOOT}", ["Title", LONG]),
    "links below the content": (f"<div class=story><p>{LONG}</p><p>{NEXT}</p></div>{LINKS}", [LONG, NEXT]),
    "links above the content": (f"{LINKS}<div class=wrap><div class=story><p>{LONG}</p><p>{NEXT}</p></div></div>", [LONG, NEXT]),
    "nested wrappers": (f"<div id=a><div id=b><div id=c><p>{LONG}</p></div></div></div>", [LONG]),
    "sections of an article": (
        f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{NEXT}</p></section></article>",
        ["One", LONG, "Two", NEXT]),
    "article in main with an aside": (f"<main><article><p>{LONG}</p><aside><p>{NEXT}</p></aside></article></main>", [LONG]),
    "paragraphs in the body": (f"{MENU}<p>{LONG}<p>{NEXT}{FOOT}", [LONG, NEXT]),
    "table layout": (f"<table><tr><td class=menu><a href=1>Home</a><td><h1>Title</h1><p>{LONG}</p></table>", ["Title", LONG]),
    "comments section by name": (f"<article><p>{LONG}</p></article><section id=comments><p>{NEXT}</p></section>", [LONG]),
    "comments inside the article": (f"<article><p>{LONG}</p><div class=comments><p>{NEXT}</p></div></article>", [LONG]),
    "advert between paragraphs": (f"<div class=text><p>{LONG}</p><div class=advert><p>{LEAD}</p></div><p>{NEXT}</p></div>", [LONG, NEXT]),
    "lists and quotes": (f"<article><p>{LONG}</p><ul><li>first point</li><li>second point</li></ul><blockquote>{NEXT}</blockquote></article>",
                         [LONG, "first point", "second point", NEXT]),
    "links in running text": (f"<article><p>See <a href=1>this</a> and <a href=2>that</a>. {LONG}</p></article>", [f"See this and that. {LONG}"]),
    "references": (f"<article><p>a &lt; b &amp;&amp; c&nbsp;&gt; d&#8217;s &eacute;t&eacute;</p><p>{LONG}</p></article>", ["a < b && c > d’s été", LONG]),
    "white space": (f"<article><p>\n  one\t two <br> three </p><p>{LONG}</p></article>", ["one two three", LONG]),
    "broken tags": (f"<article><h1>Title<p>{LONG}</b></div><p>{NEXT}", ["Title", LONG, NEXT]),
    "scripts and styles": (f"<style>p{{}}</style><article><p>{LONG}</p><script>if (a<b) x('</p>')</script></article><script>y</script>", [LONG]),
    "forms and buttons": (f"<article><p>{LONG}</p><form><p>Your name</p><button>Send</button></form></article>", [LONG]),
    "figure and caption": (f"<article><figure><img src=1><figcaption>A picture</figcaption></figure><p>{LONG}</p></article>", ["A picture", LONG]),
    "hidden parts": (f"<article><p hidden>no</p><p style='display: none'>no</p><p>{LONG}</p></article>", [LONG]),
    "cards that link elsewhere": (
        f"<article><h1>T</h1><p>{LONG}</p><p>{NEXT}</p></article><div class=cards><article><a href=1>Card one</a></article></div>",
        ["T", LONG, NEXT]),
    "notice above": (f"<div class=cookie-notice><p>{LEAD}</p></div><div class=story><p>{LONG}</p></div>", [LONG]),
    "state names": (f"<div class='page with-sidebar'><div class=story><h1>T</h1><p>{LONG}</p></div><div class=sidebar><p>{NEXT}</p></div></div>",
                    ["T", LONG]),
    "no text": (f"{MENU}{FOOT}", []),
    "plain text": ("no markup at all", ["no markup at all"]),
}


@pytest.mark.parametrize("name", GOLD)
def test_whole_text(name):
    html, want = GOLD[name]
    assert html_paths.Page(f"<html><head><title>x</title></head><body>{html}</body></html>").text([]) == "\n".join(want)


def test_whole_text_by_votes(spark):
    """Each layout on a host of its own gives the same texts through the votes."""
    names = sorted(GOLD)
    rows = [(k * 3 + c, f"http://h{k}.example/{c}", f"<body>{GOLD[n][0]}</body>") for k, n in enumerate(names) for c in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_paths.extract(df).collect()}
    for k, n in enumerate(names):
        want = "\n".join(GOLD[n][1])
        assert {got[k * 3 + c] for c in range(3)} == {(want, len(want))}, n
