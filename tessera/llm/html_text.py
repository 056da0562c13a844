"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The innermost marking element decides a block's region: article and
main are content, elements that are by their tag, role or class a menu, header, footer, sidebar, notice, advert, form
or reader comments are not, the rest is open. Inside an article most class names are only a suspicion: what they mark is a
region of its own that the block rules decide. Pass one decides blocks by region, link density, length and stop-word
density; short blocks and long ones with few stop words stay undecided. In pass two these inherit the label of the
nearest decided neighbours in their region; where those differ or there are none, the region decides: content stays, suspected
blocks go, open blocks stay only on a page without a content region.

Reading takes time in proportion to the page, whatever its tags and quotes look like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Tags that end a block, tags without content, and those whose content is never text of the page.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("nav footer aside form button select dialog noscript template svg math iframe object canvas audio video menu".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu|menus|sidebar|side-bar|footer|header|masthead|breadcrumbs?|ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner|cookies?"
    r"|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|comments?|disqus|respond"
    r"|replies|login|signup|search|widget|toolbar|pagination|pager|skip-link|copyright)(?=$|[\s_-])",
    re.I,
)
#: Names that inside an article are but a suspicion; those of its own header are none.
SUSPECT_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|share|sharing|social|related|recommend\w*|search|widget|toolbar|copyright|overlay)(?=$|[\s_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.I)
#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were there one all their has".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux cette ou ses mais comme".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre".split(),
}
_STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}
_ALL_STOPS = frozenset().union(*_STOPS.values())
_PLAIN = re.compile(r"<[a-z/!?][^<>\"']*+>", re.I)
_HIDDEN = re.compile(r"<(script|style|title|textarea|xmp)\b[^>]*+>", re.I)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|lang|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

SHORT_WORDS, GOOD_STOPS, DENSE_LINKS, LIST_LINKS = 10, 0.2, 0.5, 0.8
GOOD, BAD = True, False
OUTSIDE, OPEN, CONTENT, SUSPECT = -1, 0, 1, 2


@dataclass
class Block:
    """A block's text, the region's kind and number, its tag, and characters in links."""

    text: str
    kind: int
    region: int
    tag: str
    linked: int
    label: bool | None = None


def marks(html: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, tag) of each piece of markup in order; the tag is None for comments and what hides its content.

    A quote that is never closed, and a `<` from which no tag ends, are ordinary characters. Where a search has come to nothing
    it is remembered, so no part of the page is searched time and again.
    """
    failing: set[int] = set()  # places outside quotes from which no tag ends
    stop = (-1, -1, "")  # a search for the next stop: from, its place, the character
    closing: dict[str, bool] = {}  # elements that have no end tag further on
    at = html.find("<")
    while at >= 0:
        end, tag = -1, None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif hidden := _HIDDEN.match(html, at):
            name, end = hidden[1].lower(), len(html)
            if not closing.get(name):
                last = re.compile(f"</{name}[^>]*+>", re.I).search(html, hidden.end())
                closing[name], end = last is None, last.end() if last else len(html)
        elif plain := _PLAIN.match(html, at):
            end, tag = plain.end(), plain.group()
        elif html[at + 1 : at + 2].isascii() and (html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] in ("/", "!", "?")):
            place, path = at + 1, []
            while place not in failing:
                path.append(place)
                if not stop[0] <= place <= stop[1]:
                    found = _STOP.search(html, place)
                    stop = (place, found.start(), found.group()) if found else (place, len(html), "")
                if stop[2] in ("", ">"):
                    end = stop[1] + 1 if stop[2] else -1
                    break
                closed = html.find(stop[2], stop[1] + 1)
                place = (stop[1] if closed < 0 else closed) + 1
            if end < 0:
                failing.update(path)
            tag = html[at:end] if end >= 0 else None
        if end >= 0:
            yield at, end, tag
        at = html.find("<", end if end >= 0 else at + 1)


def blocks(html: str) -> tuple[list[Block], str | None]:
    """The blocks of a page in order, and its language if it states one."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", OPEN, 0)]  # open elements: tag, kind and number of their region
    places: dict[str, list[int]] = {}  # of each tag's open elements on the stack
    links = linked = regions = at = 0
    lang = None
    tag_of_block = ""

    def push(tag: str, kind: int, region: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, kind, region))

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop()[0]].pop()

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][2], tag_of_block, linked))
        parts, linked = [], 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = html[at:end]
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len("".join(piece.split()))

    for start, end, mark in marks(html):
        text_to(start)
        at = end
        if mark is None or mark[1] in "!?":
            continue
        closing = mark[1] == "/"
        name = re.match(r"[a-z][a-z0-9:-]*", mark[1 + closing :], re.I)
        if not name:
            continue
        tag = name.group().lower()
        if tag == "a":
            links = max(0, links + (-1 if closing else 1)) if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            continue
        is_block = tag in BLOCK_TAGS or tag in OUTSIDE_TAGS
        found_attributes = {} if closing or "=" not in mark and " hidden" not in mark else {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(mark)}
        if tag == "html":
            lang = (found_attributes.get("lang") or "")[:2].lower() or lang
        opened = places[tag][-1] if places.get(tag) else 0
        if not is_block and not found_attributes and not opened:
            continue
        if closing:
            if is_block or stack[-1][1:] != stack[opened - 1][1:]:  # an inline end within one region ends no block
                close()
            if opened:
                cut(opened)
            links = 0 if is_block else links
            continue
        kind = marked(tag, found_attributes, stack[-1][1])
        if not is_block and kind is None:
            if opened:  # so that its end is not taken for that of the marked one around it
                push(tag, stack[-1][1], stack[-1][2])
            continue
        close()
        tag_of_block = tag
        if tag == "hr":
            continue
        if kind is not None:
            regions += 1
        if tag == "p" and stack[-1][0] == "p":  # a paragraph ends where the next begins
            cut(len(stack) - 1)
        push(tag, stack[-1][1] if kind is None else kind, stack[-1][2] if kind is None else regions)
    text_to(len(html))
    close()
    return out, lang


def marked(tag: str, attributes: dict[str, str], outer: int) -> int | None:
    """The kind of region that an element opens, or None."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"):
        return OUTSIDE if COMMENT_NAMES.search(names) else CONTENT
    if tag in ("html", "body"):
        return None
    inside = outer in (CONTENT, SUSPECT)
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
    if tag in OUTSIDE_TAGS or hidden or attributes.get("role", "").lower() in OUTSIDE_ROLES or tag == "header" and not inside:
        return OUTSIDE
    if not OUTSIDE_NAMES.search(names) or tag in ("h1", "h2", "h3"):
        return None
    if not inside or OUTSIDE_NAMES.search(SUSPECT_NAMES.sub(" ", names)):
        return OUTSIDE
    return None if HEADER_NAMES.search(names) else SUSPECT


def classify(found: list[Block], lang: str | None) -> None:
    """Sets the label of each block in two passes."""
    stops = _STOPS.get(lang or "", _ALL_STOPS)
    for b in found:
        size = len(b.text.replace(" ", ""))
        density = b.linked / size
        words = b.text.lower().split()
        prose = len(words) >= SHORT_WORDS and sum(w.strip(".,;:!?\"'()") in stops for w in words) >= GOOD_STOPS * len(words)
        if b.kind == OUTSIDE:
            b.label = BAD
        elif b.kind == CONTENT:
            b.label = BAD if density > LIST_LINKS and b.tag in ("li", "td", "div", "dd", "ul") else GOOD if prose else None
        elif density > DENSE_LINKS or "\N{COPYRIGHT SIGN}" in b.text and len(words) < 2 * SHORT_WORDS:
            b.label = BAD
        elif prose:
            b.label = GOOD
    before: list[tuple[bool | None, int]] = []
    last: dict[int, tuple[bool, int]] = {}
    for k, b in enumerate(found):
        before.append(last.get(b.region, (None, 0)))
        if b.label is not None:
            last[b.region] = (b.label, k)
    after: dict[int, tuple[bool, int]] = {}
    has_content = any(b.kind == CONTENT for b in found)
    for k in range(len(found) - 1, -1, -1):
        b = found[k]
        if b.label is not None:
            after[b.region] = (b.label, k)
            continue
        (left, i), (right, j) = before[k], after.get(b.region, (None, 0))
        if left is None or right is None:
            label = right if left is None else left
        elif left == right:
            label = left
        else:
            label = left if k - i < j - k else right if j - k < k - i else None
        b.label = (b.kind == CONTENT or b.kind == OPEN and not has_content) if label is None else label
        # what is inherited decides nothing further: after and before hold first-pass labels only


def main_text(html: str) -> str:
    """The content blocks of a page, one to a line."""
    found, lang = blocks(html)
    classify(found, lang)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html) to (page_id, url, text, n_chars), a row for each row.

    A null or empty html gives an empty text and 0; a page without content blocks too. A null url stays null. n_chars counts
    code points. A page of any size is read whole, in time in proportion to it, by one task. Repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """extract() of every page."""
    return extract(table(spark, sf_dir, "pages"))
