"""Main text of web pages by a site style tree.

The DOMs of one host are merged by the path of each element (tags with their classes and ids; neighbouring siblings of one
kind count once). For every merged element the entropy of the presentations below it and the entropy of its contents over
the pages of the host, both to the base of the number of pages, make its importance: a menu that is the same everywhere has
none, an article that is new on each page has all. Elements that say themselves what they are (nav, footer, class="ad")
have no importance from the start. Branches of low importance are cut from each page, and the blocks that stay are its
text. Where a host has too few pages for an entropy, and for the plain blocks of an article, the entropy decides nothing:
a page that is a copy of another keeps its text.

Counting is a two-level aggregation over (host, element, content), so a host with a third of all pages is summed where it
lies; back come only the elements to be cut. Pages never meet in one place.

Cases: a null or empty html has an empty text; a null url is a host of its own name (empty); repeated rows are kept, one
output row per input row; other columns are ignored; an empty table gives an empty result; broken markup is read as
browsers do as far as text is concerned (unclosed elements, bare ampersands, scripts with tags in strings).
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CELL = frozenset(("td", "th"))
#: Opening one of these ends an open element of the second kind, up to the boundary kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE_TAGS = frozenset("head nav footer aside form button label fieldset menu dialog".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond login search searchbox widget toolbar "
    "pagination pager skip copyright legal disclaimer".split()
)
MAIN = frozenset(("article", "main"))
P_SCOPE = MAIN | CELL | {"div", "section", "body", "li", "blockquote"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


#: Parts that the pages of a host are dealt to.
PARTS = 64


@dataclass
class Bounds:
    """importance under which a branch is cut, and the pages a host needs for an entropy."""

    importance: float = 0.15
    min_pages: int = 12
    #: Weight of the presentation against the content, falling with the number of children.
    decay: float = 0.9


@dataclass(slots=True)
class Node:
    tag: str
    key: str
    noise: bool
    plain: bool
    in_main: bool
    parts: list = field(default_factory=list)


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """What an element is to the style tree, and whether it names itself as no content."""
    noise = tag in NOISE_TAGS or bool(HIDDEN.search(attributes))
    said = [tag]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = html.unescape(a or b or c).lower()
        words = re.findall(r"[^\W\d_]+", value)
        if name.lower() == "role":
            noise |= value.strip() in NOISE_ROLES
        elif tag not in ("body", "html"):
            noise |= any(w in NOISE_WORDS for w in words)
        said.append(name.lower() + "=" + "-".join(words))
    return " ".join(said), noise


def _attributes_end(text: str, at: int, unclosed: set[str]) -> int:
    """Where the attributes of a tag end. A quote counts behind an equals sign and where it is closed; unclosed: quotes that never are again."""
    while (at := PLAIN.match(text, at).end()) < len(text) and (quote := text[at]) != ">":
        if quote not in unclosed and text[max(0, at - 80) : at].rstrip().endswith("="):
            end = text.find(quote, at + 1)
            if end < 0:
                unclosed.add(quote)
            else:
                at = end
        at += 1
    return at


class _Open(list):
    """The elements under way, and how many there are of each tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: dict[str, int] = {}

    def add(self, node: Node) -> None:
        self.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def close(self, kinds, scope=()) -> None:
        """End the innermost element of these kinds and all inside it, unless one of the scope stands between."""
        if not any(self.count.get(k) for k in kinds):
            return
        for depth in range(len(self) - 1, 0, -1):
            if self[depth].tag in kinds:
                for node in self[depth:]:
                    self.count[node.tag] -= 1
                del self[depth:]
                return
            if self[depth].tag in scope:
                return


def parse(text: str | None) -> Node:
    """The page as a tree; parts of a node are strings and nodes in order. One pass, whatever the nesting."""
    root = Node("", "", False, True, False)
    stack, at, text = _Open(root), 0, text or ""
    n, unclosed = len(text), set()
    while at < n:
        m = TAG.search(text, at)
        if m is None:
            stack[-1].parts.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        attributes = text[at : (at := _attributes_end(text, at, unclosed))]
        at += 1
        if m[1]:
            stack.close((tag,))
            continue
        if tag in BLOCK and tag != "br":
            stack.close(("p",), P_SCOPE)
        if tag in ENDS:
            stack.close(ENDS[tag], SCOPE[tag])
        said, noise = _signature(tag, attributes)
        up = stack[-1]
        in_main = up.in_main or tag in MAIN
        if tag == "header" and not up.in_main:
            noise = True
        node = Node(tag, hashlib.md5(f"{up.key}>{said}".encode()).hexdigest()[:16], noise, " " not in said, in_main)
        up.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.add(node)
    return root


def _contents(root: Node) -> dict[int, str]:
    """A hash of what each node below the root holds, by its id(): from its texts and the hashes of its children, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if not isinstance(x, str)]
    found: dict[int, str] = {}
    for node in reversed(order):
        said = [" ".join(x.split()) if isinstance(x, str) else found[id(x)] for x in node.parts]
        said = [x for x in said if x]
        found[id(node)] = hashlib.md5("\n".join(said).encode()).hexdigest()[:16] if said else ""
    return found


def elements(root: Node) -> list[tuple[str, str, str, int]]:
    """(key, presentation, content, children) of the elements that an entropy may judge; those of one key are put together."""
    found: dict[str, tuple[list[str], list[str]]] = {}
    todo, contents = [root], _contents(root)
    while todo:
        node = todo.pop()
        for x in reversed([x for x in node.parts if not isinstance(x, str)]):
            if not x.noise:
                todo.append(x)
        if node is root or node.tag in MAIN or node.tag in ("html", "body") or (node.plain and node.in_main):
            continue
        style: list[str] = []
        for x in node.parts:
            if not isinstance(x, str) and (not style or style[-1] != x.tag):
                style.append(x.tag)
        s, c = found.setdefault(node.key, ([], []))
        s.append(",".join(style))
        c.append(contents[id(node)])
    short = lambda x: hashlib.md5("\n".join(x).encode()).hexdigest()[:16]
    return [(k, short(s), short(c), s[0].count(",") + 1) for k, (s, c) in found.items()]


def blocks(root: Node, cut: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The blocks of text that stay, in page order."""
    mains: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.noise or node.key in cut:
            continue
        if node.tag in MAIN:
            mains.append(node)
            continue
        todo.extend(reversed([x for x in node.parts if not isinstance(x, str)]))
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        said = " ".join("".join(line).split())
        if said:
            out.append(said)
        line.clear()

    for top in mains or [root]:
        work: list = [top]
        while work:
            x = work.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not (x.noise or x.key in cut):
                if x.tag in BLOCK:
                    end()
                    work.append(None)
                elif x.tag in CELL:
                    line.append(" ")
                work.extend(reversed(x.parts))
        end()
    return out


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def low_importance(pages: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(host, cut): for each host the elements of its style tree to be cut."""
    import pyarrow as pa

    def look(batches):
        for batch in batches:
            rows = [(h, *e) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in elements(parse(x))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int32()], strict=True)], names=["host", "key", "style", "content", "children"])

    seen = pages.select(_host("url").alias("host"), "html").mapInArrow(look, "host string, key string, style string, content string, children int")
    # Both entropies come from counts of values: first by value, then by element.
    counted = (
        seen.select("host", "key", "children", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x"))
        .groupBy("host", "key", "x.kind", "x.value")
        .agg(F.count("*").alias("n"), F.max("children").alias("children"))
    )
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log2("n")).otherwise(0.0))
    merged = counted.groupBy("host", "key").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("m"), of(0).alias("style"), of(1).alias("content"), F.max("children").alias("children")
    )
    merged = merged.where(F.col("m") >= bounds.min_pages)
    entropy = lambda name: 1 - F.col(name) / (F.col("m") * F.log2("m"))
    weight = F.pow(F.lit(bounds.decay), F.col("children"))
    importance = (1 - weight) * entropy("style") + weight * entropy("content")
    low = merged.where(F.greatest(importance, entropy("content")) < bounds.importance)
    return low.groupBy("host").agg(F.collect_list("key").alias("cut"))


def extract_text(pages: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    import pyarrow as pa

    # A host may have a third of all pages: its few elements go to each of its parts.
    low = low_importance(pages, bounds).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = pages.select("page_id", "url", "html", _host("url").alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int").alias("part"))
    joined = dealt.join(low, ["host", "part"], "left").select("page_id", "url", "html", "cut")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches):
        for batch in batches:
            texts = ["\n".join(blocks(parse(h), set(c or ()))) for h, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return joined.mapInArrow(extract, schema)
