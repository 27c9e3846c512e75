"""Main text of web pages by wrapper induction.

Pages become trees of block elements whose leaves are stretches of text. Elements that are never part
of an article (menus, footers, adverts, forms, ...) are left out by tag, role or class. What remains
is aligned by simple tree matching with reference pages of the same host: a leaf that is aligned to
the same text in enough of them is template, a leaf that varies is content. A reference that leaves much
less of a page's text unshared than another one does is a copy of it and shows nothing about the template.
"""

from __future__ import annotations

import difflib
import html as html_lib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, sliced, texts_of

#: Reference pages of a page: so many other distinct pages of its host, those of the smallest hashes. A leaf
#: is template if at least `LEAST` of those that have anything in common with the page and are no copies, and
#: this share of them, have its text at its place: low enough for a host of several layouts, or a notice that
#: not all pages show.
REFERENCES = 16
LEAST = 3
SHARE = 1 / 4
#: A page of which all references share all but this share of the text has copies only.
NEAR_EQUAL = 0.02
#: Pages of a host that one task reads, about.
HOT_PAGES = 256
#: Child lists up to this product of lengths are aligned as they are; of longer ones first equal stretches,
#: then what lies between these, in bands of `BAND` places to both sides where it is longer still.
PRODUCT = 10_000
BAND = 50
#: Python calls that the comparison of two trees may nest; a level takes three.
DEEPEST = 1_000_000

# A comment, a declaration, or a tag. Quoted values may hold any character; what is tried for one `<` is
# bounded, so that broken markup takes linear time.
_VALUE = r"\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,1000}+\"|'[^']{0,1000}+'"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|{_VALUE}){{0,200}}+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
_LEFT_OUT = set(
    "script style noscript template nav footer aside form button select option datalist textarea title head "
    "iframe svg math canvas audio video object map dialog menu".split()
)
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_CLASSES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar "
    "navigation menu header masthead footer cookie cookies consent gdpr notice notices banner comment comments "
    "disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager subscribe subscription newsletter signup popup modal overlay widget toolbar skip hidden".split()
)
#: What names of such elements are put together with, as in site-header or ad_box_2.
_AFFIXES = set(
    "site page main global top bottom left right primary secondary container wrapper wrap box area block list "
    "section bar links inner outer slot unit".split()
)
#: Names of what readers write, and what these are put together with; they go with all they hold.
_COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
_COMMENT_AFFIXES = _AFFIXES | set(
    "area author body content count entry form item link list meta reply respond section text thread title".split()
)
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
_SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header"}


@dataclass(slots=True, eq=False)
class Node:
    label: str
    children: list["Node"] = field(default_factory=list)
    text: str | None = None
    mark: int = 0
    size: int = 1
    doubtful: bool = False  # named like an element that is never part of an article
    comment: bool = False  # named like what readers write

    def seal(self) -> "Node":
        """Set the mark, equal for equal subtrees with equal text, and the size, from the leaves up."""
        order, stack = [], [self]
        while stack:
            order.append(node := stack.pop())
            stack += node.children
        for node in reversed(order):
            held = node.text if node.text is not None else str([c.mark for c in node.children])
            node.mark = crc32(f"{node.label}\n{held}".encode()) << 32 | crc32(f"{held}\r{node.label}".encode())
            node.size = 1 + sum(c.size for c in node.children)
        return self

    def leaves(self) -> list["Node"]:
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.text is not None or node.label == "#text":
                found.append(node)
            stack += reversed(node.children)
        return found

    def packed(self) -> list:
        """Label, mark and number of children of every node, a node before its children."""
        flat, stack = [], [self]
        while stack:
            node = stack.pop()
            flat += [node.label, node.mark, len(node.children)]
            stack += reversed(node.children)
        return flat


def unpacked(flat: list) -> Node:
    nodes = [Node(label, [], None, mark) for label, mark in zip(flat[::3], flat[1::3], strict=True)]
    waiting: list[tuple[Node, int]] = []
    for node, children in zip(nodes, flat[2::3], strict=True):
        if waiting:
            parent, left = waiting.pop()
            parent.children.append(node)
            if left > 1:
                waiting.append((parent, left - 1))
        if children:
            waiting.append((node, children))
    for node in reversed(nodes):
        node.size = 1 + sum(c.size for c in node.children)
    return nodes[0]


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _LEFT_OUT or (tag == "header" and not in_article):
        return True
    return any(
        name.lower() == "role" and "".join(values).strip().lower() in _ROLES for name, *values in _ATTRIBUTE.findall(attributes)
    ) and tag not in ("body", "html", "main")


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether a class or the id is, as a whole, a name of what is left out: not has-sidebar or share-prices."""
    if "=" not in attributes or tag in ("body", "html", "main", "article"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split() if name.lower() != "role" else ():
            words = set(_NAME.findall(token))
            if not words.isdisjoint(_CLASSES) and words <= _CLASSES | _AFFIXES:
                return True
    return False


def _of_readers(tag: str, attributes: str) -> bool:
    """Whether a class or the id begins with a name of comments: comment-body, not no-comments."""
    if "=" not in attributes or tag in ("body", "html", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split() if name.lower() != "role" else ():
            words = _NAME.findall(token)
            if words and words[0] in _COMMENTS and set(words) <= _COMMENTS | _COMMENT_AFFIXES:
                return True
    return False


def _without_doubtful(root: Node) -> None:
    """Drop doubtful elements, except those that contain an article, an h1 or most of the text; comments of
    readers, however long and whatever they are marked up as, except where they contain an h1.
    """
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack += node.children
    chars: dict[int, int] = {}
    titled: dict[int, bool] = {}
    headed: dict[int, bool] = {}
    for node in reversed(order):
        chars[id(node)] = len(node.text or "") + sum(chars[id(c)] for c in node.children if not c.comment)
        headed[id(node)] = node.label == "h1" or any(headed[id(c)] for c in node.children)
        article = node.label == "article" or any(titled[id(c)] for c in node.children)
        titled[id(node)] = headed[id(node)] or (article and not node.comment)
    for node in order:
        node.children = [
            c
            for c in node.children
            if headed[id(c)]
            or not (c.comment or c.doubtful)
            or (not c.comment and (titled[id(c)] or 2 * chars[id(c)] > chars[id(root)]))
        ]


def _main_part(root: Node, articles: list[Node], mains: list[Node]) -> Node:
    """What the content is looked for in: the main element that holds the articles, else the articles. If none of
    them has a headline of its own and there is one outside, the element that holds both: a headline and what
    stands between it and the article belong to it.
    """
    if not articles:
        return Node("#root", mains[:1]) if mains else root
    parent: dict[int, Node] = {}
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        for child in reversed(node.children):
            parent[id(child)] = node
            stack.append(child)

    def above(node: Node) -> list[Node]:
        path = [node]
        while id(path[-1]) in parent:
            path.append(parent[id(path[-1])])
        return path[::-1]

    holding = {id(n) for article in articles for n in above(article)}
    around = [m for m in mains if id(m) in holding]
    if around:
        return Node("#root", around[:1])
    inside = {id(n) for article in articles for n in _nodes_of(article)}
    titles = [n for n in order if n.label == "h1"]
    outside = [n for n in titles if id(n) not in inside]
    if not outside or len(outside) < len(titles):
        return Node("#root", articles)
    paths = [above(n) for n in (outside[0], *articles)]
    common = root
    for step in zip(*paths, strict=False):
        if any(n is not step[0] for n in step):
            break
        common = step[0]
    return common if common is root else Node("#root", [common])


def _nodes_of(root: Node) -> list[Node]:
    found, stack = [], [root]
    while stack:
        found.append(node := stack.pop())
        stack += node.children
    return found


def parse(page: str) -> Node:
    """The tree of what may be content: of the articles and their headline if there are any, else of the main part
    or body.
    """
    root = Node("#root")
    stack: list[tuple[str, Node | None]] = [("#root", root)]
    articles, mains = [], []
    run: list[str] = []
    opened: Counter[str] = Counter()  # open elements by tag
    dropped = 0  # open elements that are left out
    readers = 0  # open elements of comments

    def push(tag: str, node: Node | None) -> None:
        nonlocal dropped
        stack.append((tag, node))
        opened[tag] += 1
        dropped += node is None
    at, end = 0, len(page)

    def flush() -> None:
        if run:
            if text := " ".join(html_lib.unescape("".join(run)).split()):
                node = next(n for _, n in reversed(stack) if n is not None)
                node.children.append(Node("#text", text=text))
            run.clear()

    def close(upto: int) -> None:
        nonlocal dropped, readers
        flush()
        while len(stack) > upto:
            tag, node = stack.pop()
            opened[tag] -= 1
            dropped -= node is None
            readers -= node is not None and node.comment

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            if not dropped:
                run.append(page[at:])
            break
        if found.start() > at and not dropped:
            run.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag in _INLINE:
            if not closing and not dropped and (_left_out(tag, attributes, True) or _doubtful(tag, attributes)):
                flush()
                push(tag, None)
            elif closing and dropped and stack[-1] == (tag, None):
                close(len(stack) - 1)
            continue
        if tag == "br":
            run.append(" " if not dropped else "")
            continue
        if closing:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
            continue
        if not dropped:
            flush()
        if tag in _VOID or (attributes.endswith("/") and tag in ("svg", "path")):
            continue
        if tag in _RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else end
        # a block ends an open paragraph, an item the item before it
        ended = {"p"} | _CLOSES.get(tag, set())
        for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
            name = stack[depth][0]
            if name in ended:
                close(depth)
                break
            if name in _SCOPES and name != tag:
                break
        if dropped or _left_out(tag, attributes, bool(opened["article"] or opened["main"])):
            push(tag, None)
            continue
        node = Node(tag, doubtful=_doubtful(tag, attributes), comment=_of_readers(tag, attributes))
        stack[-1][1].children.append(node)
        push(tag, node)
        readers += node.comment
        if tag == "article" and opened[tag] == 1 and not readers:
            articles.append(node)
        elif tag == "main":
            mains.append(node)
    flush()
    root = _main_part(root, articles, mains)
    _without_doubtful(root)
    return root.seal()


def _shared(a: list[Node], b: list[Node]) -> list[Node]:
    """Leaves of `a` that the best alignment of two child lists puts on equal leaves of `b`."""
    first = 0
    while first < min(len(a), len(b)) and a[first].mark == b[first].mark:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last].mark == b[-1 - last].mark:
        last += 1
    same = a[:first] + a[len(a) - last :]
    found = [leaf for node in same for leaf in node.leaves()]
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) * len(b) <= PRODUCT:
        return found + _aligned(a, b)
    blocks = difflib.SequenceMatcher(None, [n.mark for n in a], [n.mark for n in b], autojunk=False)
    i = j = 0
    for block in blocks.get_matching_blocks():
        found += _aligned(a[i : block.a], b[j : block.b])
        i, j = block.a + block.size, block.b + block.size
        found += [leaf for node in a[block.a : i] for leaf in node.leaves()]
    return found


def _aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Simple tree matching of child lists: what the order-preserving pairs of the largest weight share.

    Lists whose lengths multiply to more than `PRODUCT` are compared near the diagonal only.
    """
    if not a or not b:
        return []
    n, m = len(a), len(b)
    reach = m if n * m <= PRODUCT else BAND + -(-m // n)
    matches: list[tuple[int, list]] = []  # first place in b of each row, and its matches
    best = [(0, [0] * (m + 1))]  # the same for the largest weights; what follows a row is its last value

    def weight(i: int, j: int) -> int:
        low, row = best[i]
        return row[min(j - low, len(row) - 1)] if j >= low else 0

    for i, x in enumerate(a):
        low, high = max(0, i * m // n - reach), min(m, i * m // n + reach + 1)
        row = [match(x, y) for y in b[low:high]]
        matches.append((low, row))
        now = [weight(i, low)]
        for k, (gain, _) in enumerate(row):
            now.append(max(weight(i, low + k + 1), now[-1], weight(i, low + k) + gain))
        best.append((low, now))
    shared, i, j = [], n, m
    while i and j:
        low, row = matches[i - 1]
        here = weight(i, j)
        if j <= low or here == weight(i - 1, j):
            i -= 1
        elif j > low + len(row) or here == weight(i, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            shared += row[j - low][1]
    return shared


def match(a: Node, b: Node) -> tuple[int, list[Node]]:
    """Weight of the match of two trees (equal nodes count, equal text twice) and the leaves of `a` with equal text."""
    if a.label != b.label:
        return 0, []
    if a.mark == b.mark:
        return 2 * a.size, a.leaves()
    if not a.children or not b.children:
        return 1, []
    shared = _shared(a.children, b.children)
    return 1 + min(len(a.children), len(b.children)) + 2 * len(shared), shared


def content(page: Node, references: list[Node]) -> list[str]:
    """The texts of the leaves that are not template, in page order.

    A reference without a leaf in common is of another layout, the page itself and copies of it do not count
    either. Copies are told by what differs: a long template is shared by all pages, so what a page has of its
    own is the most that any reference leaves unshared, and a copy leaves less than half of that. If no
    reference leaves more than `NEAR_EQUAL` of the text, all of them are copies.
    """
    leaves = page.leaves()
    marks = {leaf.mark for leaf in leaves}
    whole = sum(len(leaf.text) for leaf in leaves)
    met: list[tuple[int, Node]] = []
    for reference in references:
        others = {leaf.mark for leaf in reference.leaves()}
        if reference.mark != page.mark and not marks.isdisjoint(others):
            met.append((sum(len(leaf.text) for leaf in leaves if leaf.mark not in others), reference))
    own = max((rest for rest, _ in met), default=0)
    if own <= NEAR_EQUAL * whole:
        return [leaf.text for leaf in leaves]
    usable = [reference for rest, reference in met if 2 * rest >= own]
    counts: dict[int, int] = {}
    for reference in usable:
        for leaf in _shared(page.children, reference.children):
            counts[id(leaf)] = counts.get(id(leaf), 0) + 1
    needed = max(LEAST, SHARE * len(usable))
    return [leaf.text for leaf in leaves if counts.get(id(leaf), 0) < needed]


def _packed_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "html"):
        trees = [json.dumps(parse(t).packed(), separators=(",", ":")) for t in texts_of(batch, "html")]
        yield pa.record_batch([batch.column("host"), pa.array(trees, pa.string())], ["host", "tree"])


def _hot_hosts(pages: DataFrame) -> DataFrame:
    """(host, salts) of hosts with more than `HOT_PAGES` pages and more than a 10,000th of all.

    There are fewer than 10,000 such hosts whatever the input, so the table is small enough to broadcast.
    Their pages are dealt out to `salts` parts, to each of which their references are copied.
    """
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(HOT_PAGES, total // 10_000)
    return counts.where(F.col("n") > part).select("host", F.ceil(F.col("n") / part).cast("int").alias("salts"))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: `id_col`, `url_col`, text (blocks joined by one line feed), n_chars.

    A null or empty page has an empty text. A page without a readable host, or whose host has fewer than
    `LEAST` other differing pages, is cleaned by tags and classes alone. Null ids stay, repeated rows come back
    as often as they are there, an empty table gives an empty result, other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    ).withColumn("host", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    rows = rows.withColumn("digest", F.xxhash64("html"))
    known = rows.where(F.col("host").isNotNull() & F.col("html").isNotNull())
    hot = F.broadcast(_hot_hosts(known))
    # the references of a host in one part are its first pages there; those of hot hosts are copied to all parts
    digests = known.join(hot, "host", "left_semi").select("host", "digest").distinct()
    rank = F.row_number().over(Window.partitionBy("host").orderBy("digest"))
    # there are fewer than 10,000 hot hosts, so these are few as well
    smallest = F.broadcast(digests.withColumn("rank", rank).where(F.col("rank") <= REFERENCES + 1).drop("rank"))
    chosen = known.join(smallest, ["host", "digest"]).groupBy("host", "digest").agg(F.min("html").alias("html"))
    references = (
        map_arrow(chosen.select("host", "html"), _packed_trees, "host string, tree string")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("tree")).alias("trees"))
    )
    salts = F.coalesce("salts", F.lit(1))
    part = F.pmod(F.xxhash64("id", "url", "html"), salts).cast("int").alias("part")
    dealt = rows.where(F.col("host").isNotNull()).join(hot, "host", "left")
    copied = references.join(hot, "host")
    # the references of a part come before its pages
    together = copied.select(
        "host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"), F.lit(0).alias("side"), "trees"
    ).unionByName(
        dealt.select("host", part, F.lit(1).alias("side"), "id", "url", "html", "digest"), allowMissingColumns=True
    )
    sorted_parts = together.repartition("host", "part").sortWithinPartitions("host", "part", "side", "digest")
    hostless = rows.where(F.col("host").isNull()).withColumns(
        {"part": F.lit(0), "side": F.lit(1), "trees": F.lit(None).cast("array<string>")}
    )
    columns = ["host", "part", "side", "trees", "id", "url", "html", "digest"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    found = map_arrow(sorted_parts.select(*columns), _extract, schema).unionByName(
        map_arrow(hostless.select(*columns), _extract, schema)
    )
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content of pages that follow the references of their host and part, or begin with them."""
    # trees are compared level by level, and pages may be nested as deep as they like
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    held, references, given = None, [], False
    waiting: list[tuple] = []  # rows that come before the last reference of their host: id, url and tree
    digest = None
    done: list[tuple] = []
    kinds: list[pa.DataType] = []

    def flush() -> None:
        done.extend((i, url, "\n".join(content(tree, references))) for i, url, tree in waiting)
        waiting.clear()

    def batch_of() -> pa.RecordBatch:
        ids, urls, texts = zip(*done, strict=True) if done else ((), (), ())
        sizes = pa.array(map(len, texts), pa.int64())
        columns = [pa.array(ids, kinds[0]), pa.array(urls, kinds[1]), pa.array(texts, pa.string()), sizes]
        done.clear()
        return pa.record_batch(columns, ["id", "url", "text", "n_chars"])

    for batch in sliced(batches, "html"):
        kinds = [batch.schema.field(c).type for c in ("id", "url")]
        columns = ("host", "part", "side", "trees", "id", "url", "html", "digest")
        for host, part, side, trees, i, url, page, own in zip(
            *(batch.column(c).to_pylist() for c in columns), strict=True
        ):
            if (host, part) != held:
                flush()
                held, references, given, digest = (host, part), [], host is None, None
            if side == 0:
                references, given = [unpacked(json.loads(tree)) for tree in trees], True
                continue
            if page is None:
                done.append((i, url, ""))
                continue
            if given or (own == digest and len(references) == REFERENCES + 1):
                done.append((i, url, "\n".join(content(parse(page), references))))
                continue
            if own != digest:
                if len(references) == REFERENCES + 1:
                    flush()
                    given = True
                    done.append((i, url, "\n".join(content(parse(page), references))))
                    continue
                digest = own
                references.append(parse(page))
            waiting.append((i, url, references[-1]))
        if done:
            yield batch_of()
    flush()
    if done:
        yield batch_of()


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
