"""Main text of web pages by two passes of block rules.

A page is parted into blocks at block-level tags. Pass one decides what it can:
structure first (menus, page headers and footers, sidebars, forms, adverts,
notices and comments go, as does all that stands outside an article where the
page marks one), then link density, then stop-word density and length. Short
blocks, and long ones without stop words, stay open. In pass two each open block
takes the label of the nearest decided block (of the article, where one is
marked); with none decided it stays. Attributes are read by name, so that neither
their values nor other attributes are taken for marks; a page of which nothing is
left is read again with whole names only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest block that stop words decide, least share of stop words, greatest share of linked characters, the same inside an article.
LONG, STOP_SHARE, LINK_SHARE, ARTICLE_LINK_SHARE = 70, 0.15, 0.5, 0.9
#: Fixed word lists: frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its not of on or that the this to was were will with you"
    " als am auf aus bei das dass dem den der des die ein eine einer es für hat im in ist mit nicht sich sie sind und von war zu"
    " au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas plus pour qui que se son sur un une"
    " al como con del el ella entre era las los lo más no para pero por que se sin su sus una y".split()
)
#: Fixed tag names.
UNREAD = "script|style|title|textarea|noscript|template|iframe|svg|noembed|noframes|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
FURNITURE = frozenset("nav footer aside form menu dialog select button fieldset datalist".split())
ARTICLE = frozenset({"article", "main"})
#: Fixed words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer comment comments commentlist disqus notice notices alert cookie cookies consent gdpr popup modal overlay"
    " newsletter subscribe signup share sharing social related recommended widget toolbar pagination pager login search copyright contentinfo complementary".split()
)
#: Of these, the ones that also hold for an article element itself.
REMARKS = frozenset("comment comments commentlist disqus ad ads advert advertisement sponsored promo related recommended".split())
#: What stands in a tag after its name, up to ``>`` outside quotes or, where quotes don't close, to the next one; a tag that the page ends in goes on to the end. Nothing is tried twice.
_INSIDE = r"(?>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{UNREAD})\b{_INSIDE}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_INSIDE})(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
#: Elements that hold text themselves: of their names only whole ones mark them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption td th".split()) | INLINE
#: First parts of names that say what an element has or is near, not what it is.
ABOUT = frozenset("has have with without no not is are hide show before after under over pre post".split())
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    linked: int
    furniture: bool
    in_article: bool
    section: int
    keep: bool | None = None


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        out.setdefault(m.group(1).lower(), (m.group(2) or "").strip("\"'"))
    return out


def _marks(name: str, attrs: str, parts: bool) -> set[str]:
    """The marks among the names (class, id, role) of an element.

    A name counts as a whole. With ``parts``, a part of it does too (``site-footer``,
    ``cookieNotice``), except on elements that hold text themselves and behind a first
    part like ``has``. A hidden element is marked as an overlay.
    """
    if not attrs:
        return set()
    given = _attributes(attrs)
    out: set[str] = set()
    for token in " ".join(given.get(x, "") for x in ("class", "id", "role")).split():
        out.add(token.lower())
        pieces = [x for x in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if x]
        if parts and name not in TEXTUAL and pieces and pieces[0] not in ABOUT:
            out.update(pieces)
    out &= MARKS
    hidden = "hidden" in given and given["hidden"].lower() not in ("false", "until-found")
    if hidden or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        out.add("overlay")
    return out


def blocks_of(page: str, name_parts: bool = True) -> list[Block]:
    """The page's blocks in order, not yet labelled; ``name_parts``: see ``_marks``."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name; from here on: furniture, in an article, no article even if one is marked
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    state = {"linked": 0, "link_depth": 0, "section": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, bad, inside, _ = open_tags[-1] if open_tags else ("", False, False, False)
            out.append(Block(text, min(state["linked"], len(text)), bad, inside, state["section"]))
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw:
            parts.append(raw)
            if state["link_depth"]:
                state["linked"] += len(" ".join(html.unescape(raw).split()))

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m.group().startswith("<![CDATA["):
            continue
        if m.group("raw"):
            if m.group("raw").lower() in ("title", "xmp", "textarea"):
                flush()
            continue
        name = (m.group("name") or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            state["link_depth"] = 0 if m.group("end") else 1
            continue
        attrs = m.group("attrs") or ""
        if name in INLINE and not m.group("end") and not _marks(name, attrs, name_parts):
            continue
        if name in INLINE and m.group("end") and not n_open[name]:
            continue
        flush()
        if name in VOID:
            continue
        if m.group("end"):
            if n_open[name]:
                shut = ""
                while shut != name:
                    shut = open_tags.pop()[0]
                    n_open[shut] -= 1
                state["section"] += name not in ("p", "li", "td", "tr")
            state["link_depth"] = 0
            continue
        if name in ("p", "li") and open_tags and open_tags[-1][0] == name:  # an end tag that was left out
            open_tags.pop()
            n_open[name] -= 1
        _, bad, inside, never = open_tags[-1] if open_tags else ("", False, False, False)
        marks = _marks(name, attrs, name_parts)
        never = never or bool(marks & REMARKS)
        if name in ARTICLE:
            bad = never or (bad and inside)
            inside = True
        elif name in ("body", "html"):
            bad = False
        else:
            bad = bad or name in FURNITURE or (name == "header" and not inside) or bool(marks) or name == "head"
        state["section"] += name not in ("p", "li", "td", "tr")
        open_tags.append((name, bad, inside, never))
        n_open[name] += 1
    add(page[at:])
    flush()
    return out


def _link_heavy(b: Block) -> bool:
    return b.linked > (ARTICLE_LINK_SHARE if b.in_article else LINK_SHARE) * len(b.text)


def classify(blocks: list[Block]) -> None:
    """Label all blocks, pass one and pass two."""
    marked = any(b.in_article and not b.furniture for b in blocks)
    for b in blocks:
        if b.furniture or (marked and not b.in_article):
            b.keep = False
        elif _link_heavy(b):
            b.keep = False
        elif len(b.text) >= LONG:
            words = _WORD.findall(b.text.lower())
            share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
            if share >= STOP_SHARE or b.in_article:
                b.keep = True
    # Inside a marked article only its own running text speaks for a short block; elsewhere lists of links do too.
    speaks = [b.keep is not None and not b.furniture and (not marked or (b.in_article and not _link_heavy(b))) for b in blocks]
    n = len(blocks)
    before, after, last = [-n] * n, [2 * n] * n, -n
    for i in range(n):
        before[i] = last = i if speaks[i] else last
    last = 2 * n
    for i in range(n - 1, -1, -1):
        after[i] = last = i if speaks[i] else last
    labels = [b.keep for b in blocks]
    for i, b in enumerate(blocks):
        if b.keep is None:
            near = [labels[j] for j in (before[i], after[i]) if 0 <= j < n and abs(j - i) == min(i - before[i], after[i] - i)]
            b.keep = any(near) if near else True


def extract(page: str) -> str:
    """The page's main text. If nothing is left, parts of names have misled: then only whole ones count."""
    for name_parts in (True, False):
        blocks = blocks_of(page, name_parts)
        classify(blocks)
        if any(b.keep for b in blocks):
            break
    return " ".join(b.text for b in blocks if b.keep)


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text) for every row of ``pages``; null or empty html gives an empty text, repeated rows stay repeated."""
    chosen = pages.select(F.col(id_col), F.col("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([extract(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=[id_col, "url", "text"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:2]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "text string"]))
