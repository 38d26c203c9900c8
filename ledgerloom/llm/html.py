"""Main text of web pages by two passes over blocks.

Markup is cut into blocks at block-level tags.  Elements that never hold article text (scripts, menus, forms, ...) and
elements whose class, id or role names such a part are left out with all they contain.  Pass one labels the other blocks
by length, stop-word density and link density: *good*, *bad*, or undecided when too short to tell.  Pass two gives an
undecided block the label of its nearest decided neighbours.  ``article`` and ``main`` elements are a prior only: few stop
words inside one leave a block undecided (lists, code), neighbours are looked for on the same side of the element's
border, and where that side has none decided, a block inside is good, unless all good text of the page lies outside.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import add_columns, long_field, text_field

# Words too common to carry a topic, of the languages in the tables.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat im in ist mit nicht "
    "noch sich sie sind und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui "
    "sa se ses son sont sur un une vous "
    "al como con de del el en entre era es esta este ha la las lo los más me no o para pero por que se ser sin sobre su "
    "sus también un una y ya".split()
)
# Element names.
RAW = frozenset("script style noscript template textarea iframe svg canvas object".split())
SKIPPED = frozenset("head title nav footer aside form button select option dialog menu".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words in a class, id or role that mark a part beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "reply replies respond discussion disqus search form contentinfo complementary pagination pager tags".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
LONG, SHORT, STOP_HIGH, STOP_LOW, LINKS_HIGH = 200, 70, 0.30, 0.12, 0.5


def is_beside(name: str, attributes: str) -> bool:
    """Whether an element's own names say that it is not part of the article."""
    if not attributes or name in ("html", "body", *MAIN):
        return False
    for found in NAMES.finditer(attributes):
        value = next(x for x in found.groups() if x is not None)
        parts = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
        if BESIDE.intersection(parts):
            return True
    return bool(HIDDEN.search(attributes))


class Block:
    __slots__ = ("parts", "linked", "inside", "heading")

    def __init__(self, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.inside, self.heading = 0, inside, heading

    def text(self) -> str:
        return " ".join(references.unescape("".join(self.parts)).split())


def blocks_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, inside the main element, heading) of the blocks outside left-out elements."""
    out: list[Block] = [Block(False, False)]
    stack: list[tuple[str, bool]] = []  # open block-level elements, and whether each is left out
    skipped = inside = links = at = 0

    def cut(heading: bool = False) -> None:
        if out[-1].parts:
            out.append(Block(inside > 0, heading))
        else:
            out[-1].inside, out[-1].heading = inside > 0, heading

    def put(text: str) -> None:
        if text and not skipped:
            out[-1].parts.append(text)
            if links:
                out[-1].linked += len("".join(text.split()))

    def close(name: str) -> None:
        nonlocal skipped, inside
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for gone, left_out in stack[k:]:
                    skipped -= left_out
                    inside -= gone in MAIN
                del stack[k:]
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", (m[3] or m[6] or "").rstrip("/")
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            put(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in VOID:
            if name == "hr":
                cut()
            elif name == "br":
                put(" ")
        elif closing:
            if name in BLOCKS or any(n == name for n, _ in stack):
                close(name)
                if name in BLOCKS:
                    links = 0
                    cut()
        else:
            left_out = name in SKIPPED or is_beside(name, attributes) or name == "header" and not inside
            if name in BLOCKS:
                if name == "body" or name in MAIN:
                    close("head")
                if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                    close(name)
                links = 0
            if name in BLOCKS or left_out:
                stack.append((name, left_out))
                skipped += left_out
                inside += name in MAIN
                if name in BLOCKS:
                    cut(re.fullmatch("h[1-6]", name) is not None)
    return [(text, b.linked, b.inside, b.heading) for b in out if b.parts and (text := b.text())]


def first_pass(text: str, linked: int, inside: bool, heading: bool) -> int:
    """1 good, -1 bad, 0 undecided."""
    solid = len("".join(text.split()))
    if linked > LINKS_HIGH * solid:
        return -1
    if len(text) < SHORT or heading:
        return 0
    words = text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if density >= STOP_HIGH or len(text) >= LONG and density >= STOP_LOW:
        return 1
    return 0 if inside or density >= STOP_LOW else -1


def second_pass(labels: list[int], prior: int = -1) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one, ``prior`` without any; between a good and a bad one as near, good."""
    n = len(labels)
    before, after = [(prior, n + 1)] * n, [(prior, n + 1)] * n
    last = (prior, n + 1)
    for i in range(n):
        last = (labels[i], 0) if labels[i] else (last[0], last[1] + 1)
        before[i] = last
    last = (prior, n + 1)
    for i in range(n - 1, -1, -1):
        last = (labels[i], 0) if labels[i] else (last[0], last[1] + 1)
        after[i] = last
    return [max((-b[1], b[0]), (-a[1], a[0]))[1] > 0 for b, a in zip(before, after, strict=True)]


def main_text(page: str | None) -> str:
    """Good blocks, joined by line feeds; empty for a page without any."""
    found = blocks_of(page or "")
    labels = [first_pass(*b) for b in found]
    # Whether the good text, as far as there is any, lies inside the element.
    home = not any(x > 0 for x in labels) or any(x > 0 and b[2] for x, b in zip(labels, found, strict=True))
    good = [False] * len(found)
    for side in (True, False):
        at = [k for k, b in enumerate(found) if b[2] == side]
        for k, keep in zip(at, second_pass([labels[k] for k in at], 1 if side and home else -1), strict=True):
            good[k] = keep
    return "\n".join(b[0] for b, keep in zip(found, good, strict=True) if keep)


def _extract(batch: pa.RecordBatch) -> list[list]:
    texts = [main_text(x.as_py()) for x in batch.column("html")]
    return [texts, [len(x) for x in texts]]


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; a missing or empty page has an empty text.

    Pages are read whole, however long; rows that repeat an id, or have none, are read one by one; other columns play no part.
    An empty table gives no rows.
    """
    return add_columns(
        pages.select("page_id", "url", "html"), [text_field("text"), long_field("n_chars")], _extract, ["page_id", "url"]
    )
