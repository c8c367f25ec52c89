"""Main text of web pages by site template removal.

Each page is parsed once into all its visible text blocks. Every block element outside the page's
prose is a subtree with a hash of its shape and text; Spark counts in how many pages of a host each
hash stands, and subtrees that recur across many of the host's pages are deleted with the blocks in
them. Then the markup decides on what such counts cannot show, as on hosts of few pages or for
comments, which differ from page to page: of the blocks that are left, those go that stand in
elements whose tag, role or class says that they are navigation, notices, adverts, forms or comments,
and, in a page with an article or main element, those outside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import kept, small_batches, written

#: A subtree is template if it stands in MIN_PAGES of its host and in MIN_SHARE of all the host's pages.
MIN_PAGES, MIN_SHARE = 3, 0.05
#: Subtrees of all hosts' templates that are broadcast; of more, each page is sent its own.
TEMPLATE_ROWS = 1_000_000

# Element names of the HTML standard, by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never shown, or not as text; and elements that are not the article, whatever they hold.
UNSEEN = frozenset("script style textarea title xmp iframe noembed noframes noscript template head datalist object svg canvas audio video map".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog search".split())
ENDS_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead title tr".split())
# Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies copyright "
    "discussion disqus footer menu menubar masthead modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
CONTENT = frozenset(["article", "main"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
ENDS_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for tag in RAW}
#: Elements that end an open sibling, and the elements at which the search for one stops.
SIBLINGS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))),
    **dict.fromkeys(["dd", "dt"], (frozenset(["dd", "dt"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"]))),
    **dict.fromkeys(["option"], (frozenset(["option"]), frozenset(["select"]))),
}


class Node:
    """An open element: whether its text is never seen or goes by its markup, and what its subtree's hash is made of."""

    __slots__ = ("tag", "unseen", "dropped", "inside", "shape", "order", "chars", "linked", "holds")

    def __init__(self, tag: str, unseen: bool, dropped: bool, inside: bool, order: int):
        self.tag, self.unseen, self.dropped, self.inside, self.order = tag, unseen, dropped, inside, order
        self.shape = xxhash.xxh64(tag)
        self.chars = self.linked = 0
        self.holds = False


def marked(attributes: str) -> bool:
    """Whether class, id or role name something that is not the article, or the element is hidden."""
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return True
        if name in ("class", "id", "role"):
            value = unescape(m[2] or m[3] or m[4] or "")
            if not MARKS.isdisjoint(NAME.findall(CAMEL.sub(r"\1 \2", value).lower())):
                return True
    return False


def parse(html: str) -> tuple[list[tuple[str, bool, int]], list[int], list[int]]:
    """The page's blocks: text, whether the markup leaves it, and the innermost candidate subtree around
    it; and of all candidate subtrees, outer before inner, the hash and the next candidate around. Candidates go by their
    number, -1 is none.

    In an article or main element only lists of links, and what goes by its markup, are candidates, so
    that prose stays however often it recurs; elsewhere every subtree without such prose is one.
    """
    stack = [Node("#root", False, False, False, 0)]
    blocks: list[tuple[str, int, bool, bool]] = []
    nodes: dict[int, tuple[int, bool]] = {}
    parent = [-1]  # of each element, by its order
    open_: Counter[str] = Counter()  # elements of a tag in the stack
    line: list[str] = []
    gone: list[str] = []  # of the same block, but in an element that goes by its markup
    count = 1

    def flush() -> None:
        for part, dropped in ((line, False), (gone, True)):
            text = " ".join("".join(part).split())
            part.clear()
            if text:
                blocks.append((text, stack[-1].order, stack[-1].inside, dropped))

    def close() -> None:
        node = stack[-1]
        if (line or gone) and node.tag in BLOCKS:
            flush()
        stack.pop()
        open_[node.tag] -= 1
        code = node.shape.intdigest()
        up = stack[-1]
        up.shape.update(code.to_bytes(8, "little"))
        up.chars += node.chars
        up.linked += node.chars if node.tag == "a" else node.linked
        up.holds |= node.holds or (node.inside and not up.inside)
        if node.chars and not node.unseen and node.tag in BLOCKS and node.tag not in ("html", "body"):
            nodes[node.order] = (code, not node.holds and (not node.inside or node.dropped or (node.tag not in CONTENT and 2 * node.linked > node.chars)))

    def words(text: str) -> None:
        if "&" in text:
            text = unescape(text)
        top = stack[-1]
        seen = " ".join(text.split())
        if seen:
            top.shape.update(seen.encode("utf-8", "surrogatepass"))
            top.chars += len(seen)
        if not top.unseen:
            (gone if top.dropped else line).append(text)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            words(html[at:])
            break
        if m.start() > at:
            words(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if (line or gone) and tag in BLOCKS:
                flush()
            if open_[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if (line or gone) and (tag in BLOCKS or tag == "hr"):
            flush()
        if tag in VOID:
            if tag == "br" and not stack[-1].unseen:
                (gone if stack[-1].dropped else line).append(" ")
            stack[-1].shape.update(tag.encode())
            continue
        if tag in ENDS_P and open_["p"]:  # a new block ends an open paragraph and the inline elements left open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in SIBLINGS:
            ended, stops = SIBLINGS[tag]
            for i in () if not any(open_[x] for x in ended) else range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in stops:
                    break
        up = stack[-1]
        # an article's own header holds its headline; an article within an article is a reader's comment
        dropped = up.dropped or tag in DROPPED or (tag == "header" and not up.inside) or (tag == "article" and open_["article"] > 0)
        dropped = dropped or (len(m[3]) > 3 and tag not in ("html", "body", "main") and marked(m[3]))
        unseen = up.unseen or tag in UNSEEN
        stack.append(Node(tag, unseen, dropped or unseen, up.inside or (tag in CONTENT and not dropped and not unseen), count))
        parent.append(up.order)
        open_[tag] += 1
        count += 1
        if tag in RAW:
            m = ENDS_RAW[tag].search(html, at)
            at = m.end() if m else end
            close()
    while len(stack) > 1:
        close()
    flush()
    prose = any(inside and not dropped for _, _, inside, dropped in blocks)
    # the innermost candidate around each element, itself included
    codes, above, near = [], [], [-1] * count
    for o in range(1, count):
        near[o] = near[parent[o]]
        code, candidate = nodes.get(o, (0, False))
        if o in nodes and (candidate or not prose):
            above.append(near[o])
            near[o] = len(codes)
            codes.append(signed(code))
    return [(text, not dropped and (inside or not prose), near[o]) for text, o, inside, dropped in blocks], codes, above


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``key``, ``url`` and ``text`` for each row of ``pages``.

    A null, empty or textless html gives the empty text. The host is the part of the url between
    ``//`` and the next ``/``, ``?``, ``#`` or port, without a user, in lower case; null and odd urls
    share the empty host. Repeated rows are pages of their own and each count. A page without article
    that is template from end to end keeps its blocks, as nothing else could be its text.
    """
    small_batches(pages.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    host = F.lower(F.regexp_extract(F.coalesce(pages[url].cast("string"), F.lit("")), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(pages[key].alias("k"), pages[url].alias("u"), host.alias("host"), pages[html].alias("html"))
    block = pa.list_(pa.struct([("text", pa.string()), ("stays", pa.bool_()), ("around", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(h) if h else ([], [], []) for h in b.column(3).to_pylist()]
            blocks = [[{"text": t, "stays": s, "around": a} for t, s, a in p[0]] for p in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(blocks, block), pa.array([p[1] for p in found], pa.list_(pa.int64())), pa.array([p[2] for p in found], pa.list_(pa.int32()))],
                names=["k", "u", "host", "blocks", "subtrees", "above"],
            )

    shape = f"k {types[key]}, u {types[url]}, host string, blocks array<struct<text: string, stays: boolean, around: int>>, subtrees array<bigint>, above array<int>"
    parsed = kept(rows.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()))

    sizes = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    counts = parsed.select("host", F.explode(F.array_distinct("subtrees")).alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    template = written(counts.join(sizes, "host").filter(F.col("n") >= F.col("pages") * MIN_SHARE).select("host", "subtree"), "template")
    if template.count() <= TEMPLATE_ROWS:  # of a host at most 1 / MIN_SHARE times the subtrees of a page
        deleted, by = F.broadcast(template.groupBy("host").agg(F.collect_set("subtree").alias("deleted"))), "host"
    else:
        standing = parsed.select("host", "row", F.explode("subtrees").alias("subtree"))
        deleted, by = standing.join(template, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("deleted")), "row"

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The template goes first, then what the markup says of the rest."""
        for b in batches:
            texts = []
            for blocks, codes, above, deleted in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                gone, dead = set(deleted or ()), []
                for code, up in zip(codes, above, strict=True):
                    dead.append(code in gone or (up >= 0 and dead[up]))
                stays = [x for x in blocks if x["stays"]]
                left = [x for x in stays if x["around"] < 0 or not dead[x["around"]]]
                texts.append("\n".join(x["text"] for x in left or stays))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["k", "u", "text"])

    shown = parsed.join(deleted, by, "left").select("k", "u", "blocks", "subtrees", "above", "deleted").mapInArrow(delete, f"k {types[key]}, u {types[url]}, text string")
    return shown.select(F.col("k").alias(key), F.col("u").alias(url), "text")
