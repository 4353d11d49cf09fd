"""The main text of web pages by composite text density.

A page's tags become a tree by the usual rules for implied and missing ends. Of
every node the characters, the characters in links, the tags and the links below
are counted, and from these its composite density: characters for each tag,
lowered by the share of links in the node and on the page. The node with the
largest sum of its children's densities (its own text counts as characters for
one tag) is the core of the article. Inside an ``article`` or ``main`` the text
of that whole element is taken. Elsewhere the least density on the path from the core
up to the body is the threshold: of every node that reaches it, the subtree with the
largest sum belongs to the text, so articles in several containers stay whole. On a
page without any link all that is left of it is text.

What is never text is taken out of the tree first, so that it neither counts nor
comes back: scripts, styles and markup, forms, and what the page itself marks as
menu, header, footer, sidebar, notice, advert or comments, by its tag, its role or
the words of its class and id. A page's header goes; of an article's header the
headings stay, if it has the title. A form, and what is marked by a word only, stays where it holds most
of the page's text and nothing else is marked as the article.

Text: character references are decoded, white space inside a block (line breaks and
table cells included) becomes one space, blocks are trimmed and joined by an empty line.

Defined results for odd input: a null or empty page, one without text, and one whose
text is all taken out have the empty text; unfinished tags and comments end with the
page; elements nested more than ``MAX_DEPTH`` deep are taken as one level, which loses
no text; equal rows get equal texts; an empty table gives no rows; other columns stay,
whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import give_back_memory, ship_package, table

#: Depth of the tree beyond which elements get no level of their own.
MAX_DEPTH = 512

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment
    r"|(?:<[!?]|</(?![A-Za-z]))[^>]*+(?:>|\Z)"  # a declaration, or what stands for one
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|</?[A-Za-z][^>]*+\Z",  # an unfinished tag
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

_words = lambda s: frozenset(s.split())
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is not markup.
RAW = _words("script style title textarea xmp iframe noembed noframes")
BLOCKS = HEADINGS | _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul"
)
#: Starts that end an open paragraph.
ENDS_PARAGRAPH = (BLOCKS - _words("body caption html legend optgroup option tbody tfoot thead tr")) | _words("xmp")
#: What an implied end does not cross.
WALLS = _words("body html table td th caption object button template")
#: For a start tag: the open elements that it ends, and what guards them.
ENDS_SIBLING = {
    "li": (_words("li"), _words("ul ol menu dir")), "dd": (_words("dd dt"), _words("dl")), "dt": (_words("dd dt"), _words("dl")),
    "option": (_words("option"), _words("select datalist")), "optgroup": (_words("option optgroup"), _words("select")), "a": (_words("a"), WALLS),
    "td": (_words("td th"), _words("table tr")), "th": (_words("td th"), _words("table tr")), "tr": (_words("tr"), _words("table")),
    "tbody": (_words("tbody thead tfoot caption colgroup"), _words("table")), "thead": (_words("tbody thead tfoot caption colgroup"), _words("table")), "tfoot": (_words("tbody thead tfoot caption colgroup"), _words("table")),
} | {h: (HEADINGS, BLOCKS - HEADINGS) for h in HEADINGS}

#: Elements that are never text.
NO_TEXT = RAW | _words(
    "head noscript template object embed svg math canvas audio video map button select input datalist label output progress meter nav aside footer menu dialog search"
)
#: Roles that are never text.
NO_TEXT_ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist tooltip status")
#: Words of a class or an id that mark what is not the article, as they stand and as beginnings.
MARKED = _words("ad ads adv nav navigation navbar topbar toolbar masthead side aside notice notices alert alerts consent gdpr copyright respond reply replies share sharing widget widgets pager pagination skip login signin signup register search overlay modal toc")
MARKED_BEGINNINGS = ("advert", "banner", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "newsletter", "popup", "promo", "recommend", "related", "sidebar", "social", "sponsor", "subscri")
#: Beside these words, "header" names a part of the article.
_OWN_HEADER = _words("article post entry content story title main")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _marked(names: str) -> bool:
    """Whether a class or an id names a part that is not the article."""
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()))
    if words & MARKED or any(w.startswith(MARKED_BEGINNINGS) for w in words):
        return True
    return "header" in words and not words & _OWN_HEADER


class Page:
    """A page's tree: nodes in document order (``names``, ``parents``), and its texts and breaks in order, each with its node."""

    def __init__(self, html: str) -> None:
        self.names, self.parents = ["body"], [-1]
        self.never, self.marked = {0: False}, {0: False}  # of the nodes that have attributes or a telling name
        self.events: list[tuple[int, str | None]] = []
        self._stack, self._open = [0], {"body": 1}
        self._read(html)

    # -- the tree -------------------------------------------------------------

    def _pop_to(self, names: frozenset[str] | set[str], walls: frozenset[str]) -> bool:
        """Closes the innermost open element of ``names`` and all in it, if no wall stands before it."""
        if not any(self._open.get(n) for n in names):
            return False
        for at in range(len(self._stack) - 1, 0, -1):
            name = self.names[self._stack[at]]
            if name in names:
                for _ in range(len(self._stack) - at):
                    self._close()
                return True
            if name in walls:
                return False
        return False

    def _close(self) -> None:
        name = self.names[self._stack.pop()]
        self._open[name] -= 1
        if name in BLOCKS:
            self.events.append((self._stack[-1], None))

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name in ENDS_PARAGRAPH:
            self._pop_to({"p"}, WALLS)
        if name in ENDS_SIBLING:
            ended, guards = ENDS_SIBLING[name]
            self._pop_to(ended, guards)
        if len(self._stack) >= MAX_DEPTH:
            self.events.append((self._stack[-1], None if name in BLOCKS else " " if name in ("br", "td", "th") else ""))
            return
        node = len(self.names)
        self.names.append(name)
        self.parents.append(self._stack[-1])
        if name in NO_TEXT:
            self.never[node] = True
        elif name in ("form", "fieldset"):
            self.marked[node] = True
        if attrs and not attrs.isspace():
            self._read_attributes(node, attrs)
        if name in BLOCKS:
            self.events.append((node, None))
        elif name in ("br", "td", "th"):
            self.events.append((node, " "))
        if name not in VOID:
            self._stack.append(node)
            self._open[name] = self._open.get(name, 0) + 1

    def _read_attributes(self, node: int, attrs: str) -> None:
        for found in _ATTRIBUTE.finditer(attrs):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key in ("class", "id") and self.names[node] != "h1" and _marked(value):
                self.marked[node] = True
            elif (key == "role" and NO_TEXT_ROLES & set(value.lower().split())) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value.lower())):
                self.never[node] = True

    def _end(self, name: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name == "br":
            self._start("br", "")
        elif name in HEADINGS:
            self._pop_to(HEADINGS, WALLS)
        elif name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            self._pop_to({name}, frozenset() if name == "table" else frozenset({"table"}))
        elif name in BLOCKS or name in WALLS:
            if not self._pop_to({name}, WALLS - {name}) and name == "p":
                self.events.append((self._stack[-1], None))
        else:
            self._pop_to({name}, BLOCKS | WALLS)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(html, at)
            data = html[at : found.start()] if found else html[at:]
            if data:
                self.events.append((self._stack[-1], entities.unescape(data) if "&" in data else data))
            if found is None:
                return
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["end"]:
                self._end(name)
                continue
            self._start(name, found["attrs"])
            if name in RAW:
                ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = ended.end() if ended else len(html)
                self._pop_to({name}, frozenset())

    # -- what is text ---------------------------------------------------------

    def _weights(self, gone: list[bool]) -> tuple[list[int], list[int]]:
        """Characters of every node and all below, of those not gone, and the characters in links."""
        chars, links = [0] * len(self.names), [0] * len(self.names)
        for node, text in self.events:
            if text and not gone[node]:
                chars[node] += len(" ".join(text.split()))
        for node in range(len(self.names) - 1, -1, -1):
            if self.names[node] == "a":
                links[node] = chars[node]
            if node:
                chars[self.parents[node]] += chars[node]
                links[self.parents[node]] += links[node]
        return chars, links

    def _below(self, own: list[bool]) -> list[bool]:
        """The nodes that are, or lie below, a node of ``own``."""
        out = own[:]
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parents[node]]
        return out

    def _gone(self) -> list[bool]:
        """The nodes that are taken out."""
        names, parents = self.names, self.parents
        inside = self._below([n in ("article", "main") for n in names])
        articles = self._below([n == "article" for n in names])
        holds = [n in ("article", "main") for n in names]
        heads = [n in HEADINGS for n in names]
        titled = [n == "h1" for n in names]
        for node in range(len(names) - 1, 0, -1):
            for of in (holds, heads, titled):
                of[parents[node]] = of[parents[node]] or of[node]
        around = list(range(len(names)))  # the article or main that a node lies in
        for node in range(1, len(names)):
            around[node] = node if names[node] in ("article", "main") else around[parents[node]]
        own = [False] * len(names)
        header = [False] * len(names)
        for node in range(1, len(names)):
            name, parent = names[node], parents[node]
            own[node] = self.never.get(node, False)
            # A header around the article itself stays; of a header inside the article its headings do.
            if name == "header":
                owned = inside[parent] and (titled[node] or not titled[around[node]])
                own[node] = own[node] or not (owned or holds[node])
                header[node] = owned
            elif header[parent] and name not in HEADINGS:
                header[node] = True
                own[node] = own[node] or not heads[node]
            # An article in an article is a comment on it.
            own[node] = own[node] or (name == "article" and articles[parent])
        # A form around the article itself stays, too.
        flagged = [self.marked.get(node, False) and not (name in ("form", "fieldset") and holds[node]) for node, name in enumerate(names)]
        under = self._below(flagged)
        if not any(n in ("article", "main") and not under[k] for k, n in enumerate(names)):
            chars, links = self._weights(self._below(own))
            flagged = [f and 2 * (chars[k] - links[k]) <= chars[0] - links[0] for k, f in enumerate(flagged)]
        out = self._below([a or b for a, b in zip(own, flagged, strict=True)])
        # Text of an article's header outside of its headings.
        self._silent = {node for node in range(1, len(names)) if header[node] and names[node] not in HEADINGS}
        return out

    def densities(self, gone: list[bool]) -> tuple[list[float], list[float]]:
        """Composite density and density sum of every node that is not gone."""
        names, parents = self.names, self.parents
        chars, links = self._weights(gone)
        tags, anchors = [0] * len(names), [0] * len(names)
        for node in range(len(names) - 1, 0, -1):
            if not gone[node]:
                tags[parents[node]] += tags[node] + 1
                anchors[parents[node]] += anchors[node] + (names[node] == "a")
        share = links[0] / chars[0] if chars[0] else 0.0
        density, total, own = [0.0] * len(names), [0.0] * len(names), chars[:]
        for node in range(len(names) - 1, -1, -1):
            if chars[node] and not gone[node]:
                c, lc, t, lt = chars[node], max(links[node], 1), max(tags[node], 1), max(anchors[node], 1)
                base = math.log(c / max(c - links[node], 1) * lc + share * c + math.e)
                density[node] = c / t * math.log(max(c / lc * t / lt, 1.0), base)
                total[node] += own[node]
                if node:
                    own[parents[node]] -= c
                    total[parents[node]] += density[node]
        return density, total

    def _chosen(self, gone: list[bool]) -> list[bool]:
        """The nodes that belong to the article."""
        names, parents = self.names, self.parents
        density, total = self.densities(gone)
        core = max(range(len(names)), key=lambda k: (total[k], -k))
        path = [core]
        while path[-1]:
            path.append(parents[path[-1]])
        for scope in ("article", "main"):
            around = next((k for k in path if names[k] == scope), None)
            if around is not None:
                return self._below([k == around for k in range(len(names))])
        if "a" not in names:  # without a link nothing tells menus from text
            return [True] * len(names)
        # The path is judged on the page as it came, with its menus.
        whole, _ = self.densities(self._below([n in RAW or n in ("noscript", "template") for n in names]))
        threshold = min(min(density[k], whole[k]) for k in path)
        best = list(range(len(names)))  # the node with the largest sum in each subtree
        for node in range(len(names) - 1, 0, -1):
            a, b = best[node], best[parents[node]]
            if not gone[node] and (total[a], -a) > (total[b], -b):
                best[parents[node]] = a
        own = [False] * len(names)
        own[core] = True
        for node in range(len(names)):
            if not gone[node] and density[node] >= threshold and density[node] > 0:
                own[best[node]] = True
        return self._below(own)

    def text(self) -> str:
        """The blocks of the article, joined by an empty line."""
        gone = self._gone()
        chosen = self._chosen(gone)
        blocks: list[str] = []
        parts: list[str] = []
        for node, text in (*self.events, (0, None)):
            if text is None:
                block = " ".join("".join(parts).split())
                parts.clear()
                if block:
                    blocks.append(block)
            elif chosen[node] and not gone[node] and node not in self._silent:
                parts.append(text)
        return "\n\n".join(blocks)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    return Page(html).text() if html else ""


def _texts(pages: pa.Array) -> pa.Array:
    done = pa.array((main_text(x.as_py()) for x in pages), pa.string())
    give_back_memory()
    return done


def extracted(html: Column, spark: SparkSession) -> Column:
    """The main text of a column of pages; a page is worked on by itself, without a shuffle."""
    ship_package(spark)
    return F.arrow_udf(_texts, "string")(html.cast("string"))


def extract(pages: DataFrame, column: str = "text") -> DataFrame:
    """Adds the main text of every page."""
    return pages.withColumn(column, extracted(F.col("html"), pages.sparkSession))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages with one ``article`` of headings and paragraphs, as the given ones.
_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h[1-6])>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) AS blocks FROM a),
c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b)
SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_html_extraction": _SQL}


def queries() -> dict:
    return {"op12_html_extraction": op12_html_extraction}
