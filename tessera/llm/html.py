"""Main text of HTML pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path, the elements' classes and ids
included. Nodes are aggregated by path: text length, words, punctuation, nodes and linked text, and each
path gets three ratios: text per node, punctuation per node, and the share of text outside links. The
first two are smoothed over the page's order with a Gaussian of neighbouring blocks, the ratios are
fused by multiplication, and paths at or above a threshold of the page's own (a share of the text-weighted
mean) are content. Elements that never hold main text (navigation, header, footer, aside, forms, hidden ones, by element
or role) are left out first. An article or
main element is a weight: paths below it count WEIGHT times, and their text and punctuation score at least as
the element's own mean, as short paragraphs, cells and headings of an article are content too. A class or id that names
notices, adverts, comments and the like is a weight the other way: paths below it count a NAMED-th and are not lifted, so
comments beside an article go, but a page whose long prose stands under such a name keeps it. Where little
of the page's text is marked, paths outside can still score as content; lists of links score nothing anywhere.

Blocks are the text between block-level tags; a line break ends none. Character references are decoded,
white space inside a block becomes one space, blocks are joined by a line feed in page order.

Defined results: a null or empty page, or one without content nodes, has an empty text; unclosed and
misnested tags end with the block or the ancestor that closes; markup cut off at the end of the page is
ignored; each row gives one row; only page_id, url and html are read. Nesting may have any depth; time is linear in the page.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import small_batches

#: A path is content from this share of the page's text-weighted mean score.
THRESHOLD = 0.25
#: How much more a path counts below an article or main element.
WEIGHT = 16.0
#: How much less a path counts below an element whose name speaks against it.
NAMED = 64.0
#: Blocks to each side that smoothing looks at, and the width of its Gaussian.
WINDOW, SIGMA = 2, 1.0

# Elements of HTML by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title iframe canvas audio video select option textarea button datalist".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OFF = frozenset("nav footer aside form menu dialog".split())
_OFF_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WEAK_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|toolbar|sidebar\w*|side|aside|widget\w*|footer|foot|masthead|site-?header|page-?header|topbar|header|"
    r"comments?|commentlist|disqus|replies|respond|reader-?comments?|share|sharing|social|related|recommended|pagination|pager|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("b i em strong a span".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Elements that end an open one of the same group, by group; a paragraph ends at any block.
_GROUP = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
_NONE_OPEN = (-1,) * 6


class Path:
    """A tag path without inline elements. Equal paths of a page are one object."""

    __slots__ = ("children", "inside", "heading")

    def __init__(self, parent: Path | None = None, name: str = ""):
        self.children: dict[str, Path] = {}
        self.inside = self if name in ("article", "main") else parent.inside if parent else None  # the innermost article or main
        self.heading = name in _HEADING or parent is not None and parent.heading

    def child(self, name: str, label: str) -> Path:
        if label not in self.children:
            self.children[label] = Path(self, name)
        return self.children[label]


class Node:
    """A block's share of one tag path: text, and how much of it is linked."""

    __slots__ = ("block", "path", "text", "linked", "off", "weak", "scope")

    def __init__(self, block: int, path: Path, text: str, linked: bool, off: bool, weak: bool, scope: int):
        self.block, self.path, self.text, self.linked, self.off, self.weak, self.scope = block, path, text, linked, off, weak, scope


def _marks(name: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether the element never holds main text, and whether its class or id speaks against it."""
    off, weak = name in _OFF or name == "header" and not inside_article, False
    for m in _ATTR.finditer(attrs) if attrs and not off else ():
        key, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            off = True
        elif key == "role" and value.lower() in _OFF_ROLE:
            off = True
        elif key in ("class", "id") and name not in ("html", "body", "article", "main") and _WEAK_NAME.search(value):
            weak = True
    return off, weak


def _label(name: str, attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return name
    found = [f"{'.' if m[1].lower() == 'class' else '#'}{m[2] or m[3] or m[4] or ''}" for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id")]
    return name + "".join(found)


class _Open:
    """An open element: where its text belongs, and the nearest open element of each group that a tag may end."""

    __slots__ = ("name", "path", "hidden", "off", "weak", "scope", "linked", "nearest")

    def __init__(self, name: str, path: Path, hidden: bool, off: bool, weak: bool, scope: int, linked: bool, nearest: tuple):
        self.name, self.path, self.hidden, self.off, self.weak, self.scope, self.linked, self.nearest = name, path, hidden, off, weak, scope, linked, nearest


def nodes(page: str) -> list[Node]:
    """The page's text nodes in order. scope: 2 in an article, 1 in a main element, 0 elsewhere."""
    out: list[Node] = []
    stack = [_Open("", Path(), False, False, False, 0, False, _NONE_OPEN)]
    opened: Counter = Counter()
    block = at = 0
    n = len(page)

    def put(text: str) -> None:
        top = stack[-1]
        if text and not top.hidden:
            out.append(Node(block, top.path, text, top.linked, top.off, top.weak, top.scope))

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().name] -= 1

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            put(_html.unescape(page[at:]))
            break
        put(_html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"]:
            put(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            block += 1
        elif name == "br":
            put(" ")
            continue
        if m["close"]:
            if opened[name]:
                while stack[-1].name != name:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        attrs = m["attrs"] or ""
        if name in _VOID:
            continue
        # list items and cells end their like; any new block ends an open paragraph and what stands in it
        group = _GROUP.get(name)
        k = stack[-1].nearest[group] if group else -1
        if k < 0 and name in _BLOCK:
            k = stack[-1].nearest[0]
        if k > 0:
            close(k)
        up = stack[-1]
        off, weak = _marks(name, attrs, up.scope == 2)
        nearest = up.nearest
        if group is not None:
            nearest = (*nearest[:group], len(stack), *nearest[group + 1 :])
        elif name in _BLOCK:
            nearest = _NONE_OPEN
        path = up.path if name in _INLINE else up.path.child(name, _label(name, attrs))
        scope = 2 if name == "article" else max(up.scope, 1) if name == "main" else up.scope
        stack.append(_Open(name, path, up.hidden or name in _HIDDEN, up.off or off, up.weak or weak, scope, up.linked or name == "a", nearest))
        opened[name] += 1
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
    return out


def _smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-WINDOW, WINDOW + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(-WINDOW, WINDOW + 1):
            if 0 <= i + k < len(values):
                total += kernel[k + WINDOW] * values[i + k]
                weight += kernel[k + WINDOW]
        out.append(total / weight)
    return out


def content_blocks(found: list[Node]) -> set[int]:
    """The blocks whose tag paths score as content."""
    live = [x for x in found if not x.off and not x.text.isspace()]
    if not live:
        return set()
    sums: dict[Path, list[float]] = {}
    weak: set[Path] = set()
    marked: set[Path] = set()
    for x in live:
        if x.scope:
            marked.add(x.path)
        if x.weak:
            weak.add(x.path)
        s = sums.setdefault(x.path, [0.0, 0.0, 0.0, 0.0])
        n = len(x.text.strip())
        s[0] += n
        s[1] += len(_PUNCTUATION.findall(x.text))
        s[2] += 1
        s[3] += n * (x.linked and not (x.scope and x.path.heading))  # an article's heading may link to the article
    # paths in the order they first occur; both ratios are smoothed along it
    keys = list(sums)
    text = _smooth([sums[k][0] / sums[k][2] for k in keys])
    marks = _smooth([sums[k][1] / sums[k][2] for k in keys])
    score = {k: t * (1 + p) for k, t, p in zip(keys, text, marks, strict=True)}
    whole: dict[Path, list[float]] = {}
    for k in keys:
        if k in marked and k not in weak:
            w = whole.setdefault(k.inside, [0.0, 0.0])
            w[0] += score[k] * sums[k][0]
            w[1] += sums[k][0]
    for k in keys:
        if k in weak:
            score[k] /= NAMED
        elif k in marked:
            w = whole[k.inside]
            score[k] = WEIGHT * max(score[k], w[0] / max(w[1], 1))
        score[k] *= 1 - sums[k][3] / max(sums[k][0], 1)
    total = sum(s[0] for s in sums.values())
    mean = sum(score[k] * sums[k][0] for k in keys) / max(total, 1)
    keep = {k for k in keys if score[k] >= THRESHOLD * mean and score[k] > 0}
    return {x.block for x in live if x.path in keep}


def main_text(page: str | None) -> str:
    found = nodes(page or "")
    keep = content_blocks(found)
    blocks: dict[int, list[str]] = {}
    for x in found:
        if x.block in keep and not x.off:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=256):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], EXTRACTED.names)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, EXTRACTED)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
