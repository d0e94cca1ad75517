"""Main text of web pages: flat text blocks classified by a decision tree.

A page is flattened to text blocks in page order. Each block has its word count and link density, those of the blocks
before and after it, and three marks from the markup around it: whether it lies in a region named as furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments), whether it lies in the page's most specific content
region, and whether the page has such a region at all. A decision tree, grown here from the labelled table below,
keeps or drops each block; kept blocks are joined by one newline.

Defined results: null and empty pages, and pages without kept blocks, give the empty string; broken markup is read
leniently (unknown end tags are ignored, open elements end with the page); nothing is cut from long pages, and deep or
unclosed markup takes linear time; repeated rows are read row by row; an empty table gives an empty result; columns
besides id, url and html are left out, whatever their names.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, table, text_or_empty

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag ends when they are open.
ENDS_OPEN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button textarea fieldset label".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline cookie cookies comment comments consent disclaimer"
    " discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice overlay pagination pager popup"
    " promo promotion promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription tagcloud toolbar widget widgets".split()
)
#: Elements of which only whole class names and ids are looked up.
WHOLE_NAMES = frozenset("html body main article".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: Comment, declaration, tag (with quoted values, or else up to the next bracket), text. No alternative is tried again
#: over text that another one has passed, so that broken markup takes linear time too.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?:(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<rest>[^<>]*+)>)|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "furniture", "content", "has_content")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def marks(tag: str, raw: str) -> tuple[bool, int, bool]:
    """Of an element: furniture, rank as a content region (2 article, 1 main or named so), unseen."""
    attrs = attributes(raw)
    role = attrs.get("role", "").lower()
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    # A page's or article's own element names its state too, so there only whole names count.
    words = set(names.lower().split()) if tag in WHOLE_NAMES else {w.lower() for w in NAME_WORD.findall(names)}
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or bool(words & FURNITURE_WORDS and tag not in ("body", "html"))
    rank = 2 if tag == "article" or role == "article" or attrs.get("itemprop", "").lower() == "articlebody" else 1 if tag == "main" or role == "main" or words & CONTENT_WORDS else 0
    return furniture, 0 if furniture else rank, tag in UNSEEN or hidden


class _Open:
    """The open elements. Each keeps the state before it, and each tag its places, so no step walks the stack."""

    def __init__(self):
        self.tags: list[tuple[str, tuple[bool, int, bool, int]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.state = (False, 0, False, 0)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, furniture: bool, rank: int, unseen: bool) -> None:
        at = len(self.tags)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK and tag != "p":
            self.blocks.append(at)
        self.tags.append((tag, self.state))
        f, r, u, links = self.state
        self.state = (f or furniture, max(r, rank), u or unseen, links + (tag == "a"))

    def cut(self, at: int) -> None:
        """Close the elements from place ``at`` on."""
        while len(self.tags) > at:
            tag, self.state = self.tags.pop()
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()


def blocks_of(page: str) -> list[tuple[str, int, int, bool, int]]:
    """Text, words, words inside links, furniture and content rank of each text block in page order, in linear time."""
    out: list[tuple[str, int, int, bool, int]] = []
    parts: list[tuple[str, bool]] = []
    stack = _Open()
    skip_to = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join([p for p, _ in parts])).split())
            if text:
                linked = sum(len(entities.unescape(p).split()) for p, inside in parts if inside)
                out.append((text, text.count(" ") + 1, linked, stack.state[0], stack.state[1]))
            parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        tag = m["tag"]
        if tag is None:
            if not m[0].startswith(("<!", "<?")) and not stack.state[2]:
                parts.append((m[0], stack.state[3] > 0))
            continue
        tag = tag.lower()
        if m["end"]:
            at = stack.last((tag,))
            if tag in BLOCK or at >= 0 and stack.state[2]:
                flush()
            if at >= 0:
                stack.cut(at)
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append((" ", False))
            continue
        if tag in BLOCK:
            flush()
            ends = ENDS_OPEN.get(tag)
            p = stack.last(("p",))
            if p >= 0 and (not stack.blocks or stack.blocks[-1] < p):
                stack.cut(p)
            if ends and (at := stack.last(ends)) > stack.last(("ul", "ol", "dl", "table")):
                stack.cut(at)
        if m[0].endswith("/>") and tag not in BLOCK:
            continue
        own = marks(tag, m["attrs"] or m["rest"] or "")
        if own[2] and not stack.state[2] and (tag in BLOCK or tag == "button"):
            flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, m.end())
            skip_to = end.end() if end else len(page)
            continue
        if (own[0] or own[1] != 0) and tag not in BLOCK:
            flush()
        stack.push(tag, *own)
    flush()
    return out


def features_of(blocks: list[tuple[str, int, int, bool, int]]) -> list[tuple[float, ...]]:
    top = max((b[4] for b in blocks if not b[3]), default=0)
    own = [(float(b[1]), b[2] / b[1]) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [
        (*own[i], *around[i], *around[i + 2], float(b[3]), float(top > 0 and b[4] == top), float(top > 0)) for i, b in enumerate(blocks)
    ]


#: Blocks as (words, link density): titles, list items, paragraphs, link lists. Neighbours are of the same kinds.
KINDS = ((1, 0.0), (1, 1.0), (3, 0.0), (4, 1.0), (8, 0.0), (12, 0.6), (15, 1.0), (25, 0.3), (40, 0.0), (120, 0.0))
AROUND = ((0, 0.0), (2, 0.0), (2, 1.0), (15, 0.0), (60, 0.0))

#: FEATURES of blocks of pages without a content region and of no marked furniture, then 1 for text to keep: length and
#: links decide, and the blocks beside them. Fixed values, by hand from common page layouts.
UNMARKED = (
    (80, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1), (45, 0.05, 70, 0.0, 50, 0.1, 0, 0, 0, 1), (20, 0.1, 50, 0.0, 40, 0.0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 80, 0.0, 0, 0, 0, 1), (4, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (13, 0.0, 40, 0.0, 3, 0.9, 0, 0, 0, 1),
    (25, 0.3, 30, 0.0, 45, 0.0, 0, 0, 0, 1), (100, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (16, 0.0, 0, 0.0, 20, 0.0, 0, 0, 0, 1),
    (2, 0.0, 25, 0.0, 40, 0.0, 0, 0, 0, 1), (1, 0.0, 20, 0.0, 18, 0.0, 0, 0, 0, 1), (5, 0.0, 15, 0.0, 15, 0.0, 0, 0, 0, 1),
    (9, 0.0, 18, 0.0, 22, 0.0, 0, 0, 0, 1), (30, 0.0, 1, 1.0, 25, 0.0, 0, 0, 0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (17, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (30, 0.1, 0, 0.0, 1, 1.0, 0, 0, 0, 1),
    (20, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 1), (45, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 1), (18, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 1),
    (60, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1), (14, 0.2, 25, 0.0, 2, 0.0, 0, 0, 0, 1),
    (4, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 4, 1.0, 30, 0.0, 0, 0, 0, 0), (8, 0.9, 6, 0.8, 7, 1.0, 0, 0, 0, 0),
    (40, 0.8, 12, 0.9, 30, 0.7, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0),
    (7, 0.4, 4, 1.0, 5, 0.9, 0, 0, 0, 0), (12, 0.6, 50, 0.0, 8, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 0.0, 2, 0.5, 0, 0, 0, 0),
    (15, 1.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0),
)


def labelled_table() -> tuple[tuple[float, ...], ...]:
    """FEATURES and label of the blocks the tree is grown from.

    With a content region, every kind of block at every place is kept inside of it and dropped outside, and with or
    without one, furniture is dropped; the other blocks of pages without a region are those of UNMARKED.
    """
    rows = []
    for words, density in KINDS:
        for before in AROUND:
            for after in AROUND:
                block = (words, density, *before, *after)
                rows += [(*block, 0, 1, 1, 1), (*block, 0, 0, 1, 0), (*block, 1, 0, 1, 0), (*block, 1, 1, 1, 0), (*block, 1, 0, 0, 0)]
    return (*rows, *UNMARKED)


LABELLED = labelled_table()

#: A leaf is a label; a node is (feature, threshold, tree at or below it, tree above it).
Tree = int | tuple


def grow_tree(rows: tuple[tuple[float, ...], ...], depth: int = 12) -> Tree:
    """A binary decision tree by Gini impurity; of equal splits the first feature and lowest threshold win."""
    ones = sum(r[-1] for r in rows)
    major = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return major

    def impurity(part) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for k in range(len(rows[0]) - 1):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            below, above = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            score = impurity(below) + impurity(above)
            if best is None or score < best[0] - 1e-12:
                best = (score, k, cut, below, above)
    if best is None or best[0] >= impurity(rows) - 1e-12:
        return major
    _, k, cut, below, above = best
    return k, cut, grow_tree(tuple(below), depth - 1), grow_tree(tuple(above), depth - 1)


def label_of(tree: Tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    return "\n".join([b[0] for b, f in zip(blocks, features_of(blocks), strict=True) if label_of(tree, f)])


def extract_text(df: DataFrame, labelled=LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, main text and its number of code points."""
    tree = grow_tree(labelled)

    def batch_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, batch_texts, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
