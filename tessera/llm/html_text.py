"""HTML extraction by line-block distribution.

Markup is stripped into lines, one per block element's run of text. A line's length is its
number of characters; lines in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, told by element, role or class, and lines outside the
article (where the page marks one) have length 0, as have lines that are mostly links
where it doesn't. Lengths are summed over windows of ``WINDOW`` lines: where the sum
leaves 0 is a surge point, where it has come back to 0 a dive point, and the text between
is kept. Where the page marks no article, stretches far smaller than the largest are left
out, unless they share a block (the page itself only if it holds them or the block around
them) or a heading level with it, hold the page's first heading level, or hold prose (a
line of ``PROSE_WORDS`` words that ends as a sentence does). Lines of prose also stay if
they are mostly links.

A class or id names boilerplate by whole names, not by single words of one: ``promo`` and
``promo-box`` do, ``promo-code`` does not, as ``code`` says that it is something else.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.kernels import tidied

WINDOW, LEAST_SHARE, MOST_LINKS, PROSE_WORDS = 3, 0.25, 0.5, 5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea title".split())
#: Without an end they hold the rest of the page; others of RAW are then not there.
ENDLESS = frozenset("script style textarea title template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
                  "ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold other blocks.
HOLDERS = BLOCK - HEADINGS - {"p", "pre", "html", "body", "hr", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot",
                              "summary", "legend", "figcaption"}
ASIDE = frozenset("nav footer aside form dialog menu button select fieldset head".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id names of boilerplate.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies "
                  "consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment "
                  "comments respond reply replies disqus discussion share sharing social related recommended newsletter subscribe "
                  "subscription signup login popup modal overlay footer header masthead topbar toolbar pagination pager widget "
                  "copyright legal disclaimer paywall search form".split())
#: Words that say where or how large something is, or what holds it, but not what it is.
NEUTRAL = frozenset("site page main top bottom left right inner outer box block bar section area container wrapper wrap row col column "
                    "content list item items link links button buttons widget module unit slot panel group holder primary secondary "
                    "global user js mobile desktop sticky fixed small large big new the my id no".split())
#: What readers write, and words for what they write about.
READERS = frozenset("comment comments replies disqus".split())
ABOUT = frozenset("post posts article story blog entry news reader readers".split())
#: Inside an article some of them name the article's own parts.
WITHIN_ARTICLE = MARKS - {"header", "related", "legal", "search", "form", "discussion"}


def _marked(attributes: str, inside: bool) -> bool:
    """Whether class, id or role names boilerplate, or the element is hidden."""
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and (not value or value.lower() == "hidden"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            marks = WITHIN_ARTICLE if inside else MARKS
            for token in value.split():
                words = {w.lower() for w in _PART.findall(token) if not w.isdigit()}
                if words & marks and words <= MARKS | NEUTRAL:
                    return True
                if words & marks & READERS and words <= MARKS | NEUTRAL | ABOUT:
                    return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool, bool, bool, tuple]], bool, bool]:
    """Lines as (text, characters in links, boilerplate, in the article, in main, kin), and whether the page marks an article or main.

    ``kin`` are the starts of the blocks around the line (-1: the page, if no more than one
    block is between) and the heading that it is.
    """
    out: list[tuple[str, int, bool, bool, bool, tuple]] = []
    stack: list[tuple[str, bool, str, int]] = []  # element, boilerplate, "article" or "main" or "", where it starts
    text: list[str] = []
    linked = 0
    dull = 0  # open boilerplate elements
    home = {"article": 0, "main": 0}
    found = {"article": False, "main": False}

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            around = [s[3] for s in stack if s[0] in HOLDERS]
            kin = (*around, *[s[0] for s in stack if s[0] in HEADINGS], *((-1,) if len(around) < 2 else ()))
            out.append((line, linked, dull > 0, home["article"] > 0, home["main"] > 0, kin))
        text.clear()
        linked = 0

    def leave() -> None:
        nonlocal dull
        _, was_dull, part, _ = stack.pop()
        dull -= was_dull
        if part:
            home[part] -= 1

    links = at = 0
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if links:
                linked += len("".join(html.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if closing:
            if name == "a":
                links = 0
            if name in BLOCK:
                flush()
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    leave()
                leave()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size if name in ENDLESS else at
            text.append(" " if name not in ("script", "style") else "")
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P and stack and any(s[0] == "p" for s in stack):
                depth = max(i for i, s in enumerate(stack) if s[0] == "p")
                if not any(s[0] in BLOCK for s in stack[depth + 1 :]):
                    while len(stack) > depth:
                        leave()
            elif name in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == name:
                leave()
        if name in VOID or attributes.endswith("/"):
            if name == "img":
                text.append(" ")
            continue
        if name == "a":
            links = 1
        inside = home["article"] > 0 or home["main"] > 0
        is_dull = (name in ASIDE or name == "header" and not inside or name not in ("html", "body", "article", "main")
                   and _marked(attributes, inside) or name == "article" and _marked(attributes, True))
        part = name if name in home and not is_dull and not dull else ""
        if is_dull and name not in BLOCK:
            text.append(" ")
        stack.append((name, is_dull, part, at))
        dull += is_dull
        if part:
            home[part] += 1
            found[part] = True
    flush()
    return out, found["article"], found["main"]


def prose(line: str) -> bool:
    """A sentence of some words."""
    return line.rstrip("\"')]»”’ ")[-1:] in (".", "!", "?", "…", "。") and len(line.split()) >= PROSE_WORDS


def main_text(page: str, window: int = WINDOW) -> str:
    """Lines between surge and dive points, joined by line ends."""
    rows, article, main = lines(page)
    lengths = []
    for line, linked, dull, in_article, in_main, _ in rows:
        size = len(line.replace(" ", ""))
        home = in_article if article else in_main if main else True
        links = not article and not main and linked > MOST_LINKS * size and not prose(line)
        lengths.append(0 if dull or not home or links else size)
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]  # of the window that begins at the line
    stretches, i = [], 0
    while i < n:
        if not lengths[i]:
            i += 1
            continue
        surge, i = i, i + 1
        while i < n and sums[i]:
            i += 1
        stretches.append((surge, i, sum(lengths[surge:i])))
    if not article and not main and stretches:
        kin = [{x for j in range(surge, dive) if lengths[j] for x in rows[j][5]} for surge, dive, _ in stretches]
        most = max(range(len(stretches)), key=lambda i: stretches[i][2])
        least, of = LEAST_SHARE * stretches[most][2], kin[most] | {"h1"}
        stretches = [s for s, k in zip(stretches, kin) if s[2] >= least or k & of or any(
            lengths[j] and prose(rows[j][0]) for j in range(s[0], s[1]))]
    return "\n".join(rows[j][0] for surge, dive, _ in stretches for j in range(surge, dive) if lengths[j])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(v.as_py() or "") for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, plus text and n_chars.

    A null or empty page has an empty text; very long pages are read whole; repeated rows
    each come out alike. Columns of ``pages`` named text or n_chars are replaced; the
    others pass through.
    """
    wide = pages.select(F.col(html_col).cast("string").alias("_html"),
                        *[c for c in pages.columns if c not in (html_col, "text", "n_chars")])
    return wide.mapInArrow(lambda it: tidied(_rows(it)), wide.drop("_html").schema.add("text", "string").add("n_chars", "long"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
