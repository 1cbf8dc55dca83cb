"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged into one tree. A node of it stands for a
run of neighbouring siblings of one label (tag and classes: a list's items, an
article's paragraphs) and is aligned over pages by its parent's node, its label
and how many runs of that label its parent had before. Beside its contents each
node has style nodes: the different sequences of runs that it has as children.

A node's presentation importance is the entropy of its style nodes over the
pages that have it, its content importance that of the contents below it, both
divided by the largest possible, the logarithm of the number of pages; PRIOR
more pages of their own style and content stand for what few pages don't show.
Its importance is composed of both, the presentation's with the weight 1 - GAMMA
** (number of style nodes); a node without children has its contents' only. A
node is noise if that is less than contents that recur on REPEATS pages each
would have, and if SHARE of its pages show a content that others show too: so
menus, notices and footers of the site, and slots of rotating adverts.

A page's blocks below noise whose parent is none are removed first. Then go the
branches whose tag or class says that they aren't the article (menus, forms,
comments ...), which serves hosts of few pages and texts that don't recur. If a
page has an article or main element with text left, only that counts.

A content counts once for each distinct article that it stands by, told by the
smallest hash of the article's windows of words, so copies of a page are no
template, and near copies hardly count. Null and empty pages give an empty text.
Pages are parsed whole, cut and very long ones too. Pages without a host share
the empty host. Repeated rows repeat their result. A node at the bound is no
noise. An empty table gives an empty one; other columns, whatever their names,
are left alone.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import strings, units

#: Pages of their own style and content that every node is taken to have besides.
PRIOR = 8
#: The weight of contents falls by this factor with each style node.
GAMMA = 0.9
#: A template's contents are on so many pages on average (the geometric mean).
REPEATS = 2
#: The share of a template's pages whose content other pages show too.
SHARE = 0.75
#: A tree has so many levels; what is deeper belongs to the node above.
DEPTH = 64
#: Words in a window of an article's sketch.
WINDOW = 4
#: Up to so many nodes of templates, all hosts together, are broadcast: 8 bytes each.
MOST_BROADCAST = 500_000
#: Shares into which a host's pages are dealt for the join beyond that.
SALTS = 64

#: HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
ASIDE = frozenset("head nav header footer aside form script style noscript template iframe svg math object embed applet select button textarea input label fieldset menu dialog title audio video canvas".split())
MAIN = frozenset("article main".split())
_WORDS_ASIDE = "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent notice notices popup modal comment comments reply replies disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe subscription login signup search widget toolbar copyright legal hidden"
_ASIDE_WORDS = frozenset(_WORDS_ASIDE.split())
_CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

#: Nodes from the page down, whether in a branch apart, whether in an article, text.
Block = tuple[tuple[int, ...], bool, bool, str]
ROOT = 0


class Element:
    """An open element: its tag, its nodes from the page down, whether it is apart or in an article, and its children's runs."""

    __slots__ = ("apart", "before", "block", "main", "nodes", "runs", "tag")

    def __init__(self, tag: str, nodes: tuple[int, ...], apart: bool, main: bool, above: Element | None = None):
        self.tag, self.nodes, self.apart, self.main = tag, nodes, apart, main
        self.block: Element = above.block if above and tag in INLINE else self
        self.runs: list[str] = []
        self.before: dict[str, int] = {}

    def child(self, label: str) -> tuple[int, ...]:
        """The nodes of a child of this label that begins now. Below DEPTH nodes, children belong to the last one."""
        if not self.runs or self.runs[-1] != label:
            self.runs.append(label)
            self.before[label] = self.before.get(label, 0) + 1
        if len(self.nodes) > DEPTH:
            return self.nodes
        return (*self.nodes, xxhash.xxh3_64_intdigest(f"{self.nodes[-1]} {self.before[label]} {label}") >> 1)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def parsed(page: str) -> tuple[list[Block], dict[int, list[tuple[str, ...]]]]:
    """The page's blocks of text in order, and each node's style: its elements' runs of children, equal neighbours once."""
    out: list[Block] = []
    styles: dict[int, list[tuple[str, ...]]] = {}
    stack = [Element("", (ROOT,), False, False)]
    many: Counter[str] = Counter()  # open elements of each tag
    held: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((owner.nodes, owner.apart, owner.main, text))

    def close(k: int) -> None:
        """End the elements from the k-th on."""
        for x in stack[k:]:
            many[x.tag] -= 1
            if x.tag not in INLINE:
                own, style = styles.setdefault(x.nodes[-1], []), tuple(x.runs)
                if not own or own[-1] != style:
                    own.append(style)
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        cut = m.start() if m else n
        if cut > at:
            if not held:
                owner = stack[-1].block
            if owner.apart != stack[-1].apart:  # an inline element apart, inside a block that isn't
                flush()
                owner = stack[-1]
            held.append(page[at:cut])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            if tag in ("br", "p") and many[tag] <= 0:
                held.append(" ")
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if many[tag] > 0 else 0
            if not k or tag in INLINE and any(x.tag not in INLINE for x in stack[k:]):
                continue
            if tag not in INLINE or stack[k].apart != stack[k - 1].apart:
                flush()
            close(k)
            continue
        if tag == "br":
            held.append(" ")
            continue
        attributes = m[3]
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # elements that this one ends
                closes = _CLOSES.get(stack[k].tag)
                if closes and tag in closes:
                    close(k)
                    break
                if stack[k].tag not in INLINE and stack[k].tag not in _CLOSES:
                    break
        if tag in VOID:
            continue
        above = stack[-1]
        main = above.main
        names = " ".join(sorted(x[2].strip("\"'").lower() for x in _NAMES.finditer(attributes) if x[1].lower() != "id")) if attributes and "=" in attributes else ""
        said = {w for x in _NAMES.finditer(attributes) for w in _SPLIT.split(x[2].lower())} if attributes and "=" in attributes else set()
        aside = tag in ASIDE and not (main and tag == "header") or bool(said & _ASIDE_WORDS) and tag not in ("html", "body", "main") and not (tag == "article" and not said & {"comment", "comments", "reply"})
        apart = above.apart or aside
        if tag not in INLINE or apart != above.apart:
            nodes = above.block.child(f"{tag}.{names}") if tag not in INLINE or names else above.nodes
            flush()
        else:
            nodes = above.nodes
        stack.append(Element(tag, nodes, apart, main or tag in MAIN, above))
        many[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            close(len(stack) - 1)
    flush()
    close(0)
    return out, styles


def templated(nodes: tuple[int, ...], low: set[int]) -> bool:
    """Whether one of the nodes is noise below one that isn't. Where the page's root is noise too, as on a host of copies, that says nothing about a node."""
    return any(b in low and a not in low for a, b in zip(nodes, nodes[1:]))


def judged(page: str, low: set[int]) -> tuple[str, int, int]:
    """The page's main text, how many blocks the tree removed, and how many the tags and classes besides."""
    found = [(templated(nodes, low), apart, main, text) for nodes, apart, main, text in parsed(page)[0]]
    kept = [(main, text) for template, apart, main, text in found if not template and not apart]
    text = "\n\n".join(t for main, t in kept if main) or "\n\n".join(t for _, t in kept)
    return text, sum(x[0] for x in found), sum(x[1] and not x[0] for x in found)


def main_text(page: str, low: set[int]) -> str:
    return judged(page, low)[0]


def sketch(found: list[Block]) -> int:
    """What tells a page from others that aren't near copies: the smallest hash of the windows of words of its article, else of its text without branches apart, else of all of its text."""
    words = [w for _, apart, main, t in found if main and not apart for w in t.split()] or [w for _, apart, _, t in found if not apart for w in t.split()] or [w for *_, t in found for w in t.split()]
    return min(xxhash.xxh3_64_intdigest(" ".join(words[k : k + WINDOW])) for k in range(max(1, len(words) - WINDOW + 1))) >> 1


def observed(found: list[Block], styles: dict[int, list[tuple[str, ...]]]) -> list[tuple[int, int, int]]:
    """Of each node of a page that has text below it: the node, its style (0 without children) and its content, hashed."""
    below: dict[int, xxhash.xxh3_64] = {}
    for nodes, _, _, text in found:
        own = xxhash.xxh3_64_digest(text)
        for x in nodes:
            below.setdefault(x, xxhash.xxh3_64()).update(own)
    return [(x, xxhash.xxh3_64_intdigest(repr(styles[x])) >> 1 if any(styles[x]) else 0, c.intdigest() >> 1) for x, c in below.items() if x in styles]


def nodes(pages: DataFrame) -> DataFrame:
    """host, node, style, content, n: with how many distinct articles of a host a node of its tree has a style and content. Copies of an article count once, whatever is around them."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches, "html"):
            seen: set[tuple[str, int, int, int, int]] = set()
            for u, h in zip(b.column("url").to_pylist(), strings(b.column("html"))):
                found, styles = parsed(h)
                if found:
                    own, article = host(u), sketch(found)
                    seen.update((own, *x, article) for x in observed(found, styles))
            columns = list(zip(*seen)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "node", "style", "content", "article"])

    found = rows.mapInArrow(run, "host string, node bigint, style bigint, content bigint, article bigint").distinct()
    return found.groupBy("host", "node", "style", "content").agg(F.count("*").alias("n"))


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, styles, repeated (pages with a content that recurs), presentation, content, importance: the site style trees."""
    seen = materialize(nodes(pages), "style-nodes")
    weight = lambda n: F.sum(n * F.log(n.cast("double")))
    n = F.col("n")
    contents = seen.groupBy("host", "node", "content").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(F.sum("n").alias("pages"), weight(n).alias("c"), F.sum(F.when(n > 1, n).otherwise(0)).alias("repeated"))
    styles = seen.groupBy("host", "node", "style").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(F.count("*").alias("styles"), weight(n).alias("s"), F.max("style").alias("most"))
    total = (F.col("pages") + PRIOR).cast("double")
    most = total * F.log(total)
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    found = contents.join(styles, ["host", "node"]).withColumns({"content": 1 - F.col("c") / most, "presentation": 1 - F.col("s") / most})
    composed = F.when(F.col("most") == 0, F.col("content")).otherwise((1 - share) * F.col("presentation") + share * F.col("content"))
    return found.select("host", "node", "pages", "styles", "repeated", "presentation", "content", composed.alias("importance"))


def noise(pages: DataFrame, repeats: float = REPEATS, share: float = SHARE) -> DataFrame:
    """host, node of the nodes that are noise."""
    bound = 1 - math.log(repeats) / F.log((F.col("pages") + PRIOR).cast("double"))
    return importance(pages).where((F.col("importance") < bound) & (F.col("repeated") >= share * F.col("pages"))).select("host", "node")


def extract(pages: DataFrame, repeats: float = REPEATS, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that the tree removed), n_aside (those that tags and classes removed besides)."""
    ship(pages.sparkSession)
    low = materialize(noise(pages, repeats, share).groupBy("host").agg(F.collect_list("node").alias("removed")), "style-tree")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    of = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    placed = rows.withColumn("host", of)
    if (low.agg(F.sum(F.size("removed"))).first()[0] or 0) <= MOST_BROADCAST:
        joined = placed.join(F.broadcast(low), "host", "left")
    else:  # every host's list once for each of its shares of pages, so a crowded host is many tasks
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "removed")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units(batches, "html"):
            found = [judged(h, set(r or ())) for h, r in zip(strings(b.column("html")), b.column("removed").to_pylist())]
            texts, template, aside = zip(*found)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(template, pa.int64()), pa.array(aside, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template", "n_aside"])

    return joined.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint, n_template bigint, n_aside bigint")
