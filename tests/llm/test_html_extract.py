"""Main texts of hand-made and generated pages, densities against their definition."""

from __future__ import annotations

import math
import random

import pytest

from arcstep.llm import html_extract as he

P = ["The first paragraph is long enough to be told from a menu.", "The second one goes on for a while, with a comma.", "And a third ends the story & its tale."]
FRAME = '<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{}</body></html>'
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
JUNK = [
    '<div class="ad">Buy this, it is very cheap and good for you.</div>', "<aside><p>On the side there is more to read for all.</p></aside>", '<div id="cookie-bar">We use cookies, please accept them now.</div>',
    "<form><label>Your name</label><input><p>Write to us</p><textarea>x</textarea></form>", "<footer>&copy; 2020 a publisher &middot; all rights</footer>", "<header><h2>The Daily Site</h2><p>News since ever and ever.</p></header>",
    '<section id="comments"><article><p>I liked this a lot, thank you all.</p></article></section>', '<div class="commentList"><div class="comment"><p>First! And some more words here.</p></div></div>',
    "<!-- a <p>comment</p> -->", '<div role="navigation"><p>Go here or go there or stay.</p></div>', '<p hidden>not to be seen by any reader</p>', "<script>document.write('<p>no</p>')</script>", '<div class="sidebar-left">Left side <b>text</b> for you.</div>',
]


def paragraphs(rng):
    """Paragraphs in varied markup, and the blocks they stand for."""
    html, want = [], []
    for k in range(rng.randint(2, 9)):
        text = f"{rng.choice(P)} Number {k}."
        raw = text.replace("&", "&amp;")
        html.append(
            rng.choice(
                [f"<p>{raw}</p>", f"<p>{raw}", f"<P CLASS=x>{raw}</P>", f"<div><p>{raw}</p></div>", f"<p><b>{raw}<br>", f"<p>\n {raw.replace(' ', '  ', 3)}\t</p>", f"<blockquote>{raw}</blockquote>", f"<ul><li>{raw}</ul>", f"<p>{raw.replace('The', 'T<i>he</i>')}</p>", f"<h3>{raw}</h3>"]
            )
        )
        want.append(text)
    return "".join(html), want


@pytest.mark.parametrize("seed", range(60))
def test_article_without_its_surroundings(seed):
    rng = random.Random(seed)
    body, want = paragraphs(rng)
    title = "A title &lt;here&gt;"
    junk = lambda: "".join(rng.sample(JUNK, rng.randint(0, 4)))
    kind = rng.choice(["article", "main", "nested", "div", "two"])
    if kind == "nested":
        core = f"<main>{junk()}<article><header><h1>{title}</h1><p>By someone, today</p></header>{body}{rng.choice(JUNK)}</article></main>"
    elif kind == "div":
        core = f'<div id="page" class="has-sidebar"><div class="content"><h1>{title}</h1>{body}</div>{junk()}</div>'
    elif kind == "two":
        other, more = paragraphs(rng)
        core, want = f'<div id="c"><div><h1>{title}</h1>{body}</div><div>{other}</div></div>', want + more
    else:
        core = f"<{kind}><h1>{title}</h1>{body}</{kind}>"
    page = FRAME.format(NAV + junk() + core + junk())
    assert he.main_text(page) == "\n\n".join(["A title <here>", *want])


def test_odd_pages():
    cases = {
        None: "", "": "", "abc": "abc", "<p": "", "<p>a<!-- b": "a", "<b>x</b>y <i>z": "xy z", "<script>a": "", "a < b &amp;lt; c &am &amp &quot;": 'a < b &lt; c &am & "', "<p>a&nbsp;&#32;b\n</p><p> </p>c": "a b\n\nc",
        "<div>" * 3000 + "deep" + "</div>" * 3000 + "after": "deep\n\nafter", "<table><tr><td>a<td>b<tr><td>c</table>": "a b\n\nc", '<p title="a>b" x=\'>\'>q': "q", "<nav><a>x</a></nav>": "", "</p>a</div></b>b<br/>c": "ab c", "<?xml?><![CDATA[x]]>y</ >z": "yz",
    }
    for page, text in cases.items():
        assert he.main_text(page) == text, page


def test_text_of_a_wrapping_form_stays():
    page = FRAME.format(f'<form id="aspnet"><div class="sidebar"><a href="/">Home</a></div><div id="content">{"".join(f"<p>{x}" for x in P)}</div></form><div class="notice">Read me now</div>')
    assert he.main_text(page) == "\n\n".join(P)


def test_densities_follow_their_definition():
    page = he.Page("<div><p>aaaa bbbb<a href=x>cc</a></p><p>dddddd</p></div><a>e</a>")
    density, total = page.densities([False] * len(page.names))
    c, lc, share = {"body": 18, "div": 17, "p1": 11, "p2": 6}, 3, 3 / 18
    assert [page.names[k] for k in range(6)] == ["body", "div", "p", "a", "p", "a"]

    def want(chars, links, tags, anchors):
        base = math.log(chars / max(chars - links, 1) * max(links, 1) + share * chars + math.e)
        return chars / max(tags, 1) * math.log(max(chars / max(links, 1) * max(tags, 1) / max(anchors, 1), 1), base)

    assert density[0] == pytest.approx(want(c["body"], lc, 5, 2)) and density[1] == pytest.approx(want(c["div"], 2, 3, 1))
    assert density[2] == pytest.approx(want(c["p1"], 2, 1, 1)) and density[4] == pytest.approx(want(c["p2"], 0, 0, 0))
    assert total[1] == pytest.approx(density[2] + density[4]) and total[4] == 6 and total[2] == pytest.approx(9 + density[3])


def test_query_form_keeps_rows_and_columns(spark):
    rows = [(1, None, {"a": "b"}, "x"), (2, "<p>long " + "word " * 50_000, None, None), (2, "<p>b", None, "y"), (2, "<p>b", None, "y"), (None, "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, chosen map<string,string>, text_ string")
    got = he.extract(pages)
    assert got.columns == ["page_id", "html", "chosen", "text_", "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0, 0, 1, 1, 5 * 50_000 + 4]
    assert he.extract(pages.limit(0)).count() == 0
