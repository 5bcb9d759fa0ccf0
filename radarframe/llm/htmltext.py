"""Main text of web pages, with site templates removed.

Pages are parsed into element trees. For each element subtree two hashes are taken: of its whole content, and of its
slot, which is its place (tags, classes and ids of the elements around it) with its structure (those of the blocks in it),
without any words. Both are counted for each host in Spark, once for each distinct page. A subtree whose content recurs is
a template wherever it stands outside the main part. A slot that recurs is one too, whatever its words, unless it carries
the pages' text: slots that hold on average ``MAIN`` of a page's own text are main parts, nothing inside the innermost of
them is deleted for its slot, and slots with over ``MINOR`` of a page's text are never deleted.

Tags, roles and class names that say that an element is a menu, a form, a notice, an advert and the like are a second opinion. A class
says so if all its parts do or are neutral (``site-footer``, but not ``related-work``). Where a page marks its article or main part, the text is taken from there;
of several such parts, from those with the fewest of these elements around them, and those elements then stay, as does the part itself whatever its own
class says. Otherwise marked elements are deleted, as long as they leave ``MINOR`` of the text they stand in: of those that don't, the largest is
opened, and the marked elements in it are looked at instead. So a form around the page or a class on its article deletes nothing. Inside an article
only link lists and bare containers recur as templates: its own paragraphs and headings stay, however often they are repeated.
``marks=False`` leaves that opinion out.

Defined cases: a null html is empty and has an empty text; a null url has the empty host; unclosed,
stray and cut tags are read as browsers do, more or less, an open ``<script>`` or comment runs to the end; repeated
rows keep a row each, and count as one page with all copies of their html on the host; templates that tie in their counts are all
deleted; very long or deeply nested pages take time in proportion to their length; an empty table gives an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, urlfilter

#: A subtree is a template of its host on so many distinct pages, or on this share of the host's distinct pages or their
#: square root where that is less, but on two and (of few pages) on half of them at least: see :func:`recurs`.
ENOUGH, LEAST_SHARE = 5, 0.1
#: Of a page's own text (outside links), on average over the pages with a slot.
MAIN, MINOR = 0.5, 0.2
#: Shares are summed in whole thousandths, so that sums don't depend on their order.
PARTS_OF_ONE = 1000
#: Hosts above this share of all html, so fewer than this many, are dealt to parts of about so many characters, or of this share of all where that is less.
HOT, PART_BYTES, PART_SHARE = 50_000, 32_000_000, 1000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never text, and what says of itself that it isn't the article.
DROPPED = frozenset("head script style noscript template iframe noframes svg math canvas object button select option textarea input label audio video title xmp".split())
ASIDE = frozenset("nav menu header footer aside form dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments disqus replies related share sharing social"
    " widget login toolbar pagination pager skip recommended recommendations trending".split()
)
#: What a class may say beside those and still mean them.
NEUTRAL = frozenset(
    "area bar bottom box block bottom col column container content fixed global inline inner item items js left link links list main message outer page panel primary region right row"
    " secondary section site slot small sticky top unit wrap wrapper zone".split()
)
#: What an open element's end is implied by, and the elements that it can't be ended across.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "td", "th", "tr"}
PARAGRAPH_SCOPE = frozenset("td th div article section main body li blockquote".split())
#: For each family of elements that end each other: its members and its scope.
FAMILIES = {"p": (frozenset({"p"}), PARAGRAPH_SCOPE), **{t: (frozenset(CLOSED_BY[t]), frozenset(SCOPES[t])) for t in CLOSED_BY}}
TOUCHED = frozenset().union(*(m | c for m, c in FAMILIES.values()))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Blocks that hold other blocks: what a slot can be deleted as, besides lists of links.
CONTAINERS = BLOCKS - PROSE - frozenset("html body li dt dd dl tr td th tbody thead tfoot figcaption figure legend hr summary".split())
NO_DIGITS = str.maketrans("", "", "0123456789")
#: The sets of hashes that a host has, and in how many parts they are gathered first.
ROLES_OF, DEAL = ("contents", "minor", "main"), 64


class Node:
    __slots__ = ("tag", "label", "dropped", "marked", "content", "main", "inside", "parent", "above", "over", "top", "hid", "open", "digest", "slot", "links", "size", "prose")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool, marked: bool, main: bool):
        self.tag, self.label, self.parent, self.dropped, self.marked, self.main = tag, label, parent, dropped, marked, main
        self.inside = False
        self.content: list[Node | str] = []
        # marked elements at or above it, the nearest one above, the outermost main part above, and whether it is in something that is no text
        self.above, self.over, self.top, self.hid = int(marked), None, None, False
        if parent is not None:
            self.above += parent.above
            self.over = parent if parent.marked else parent.over
            self.top = parent.top or (parent if parent.main else None)
            self.hid = parent.hid or parent.dropped
        # the nearest open element of each family this side of its scope
        self.open: dict[str, Node] = parent.open if parent is not None else {}
        if tag in TOUCHED:
            self.open = {f: n for f, n in self.open.items() if tag not in FAMILIES[f][1]}
            self.open |= {f: self for f, (members, _) in FAMILIES.items() if tag in members}


def says_aside(token: str) -> bool:
    """Whether a class or id says that its element isn't the article."""
    parts = {x for x in re.split("[^a-z]+", token) if x}
    return not CLASSES.isdisjoint(parts) and parts <= CLASSES | NEUTRAL


def read_marks(tag: str, attributes: str, marks: bool = True) -> tuple[str, bool, bool, bool]:
    """An element's label (tag, class and id, without digits), whether it is no text, whether it says that it isn't the article, and whether that it is the page's main part."""
    dropped, marked, main, label = tag in DROPPED or not marks and tag in ("form", "dialog", "search"), marks and tag in ASIDE, marks and tag in ("article", "main"), tag
    if attributes and attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and tag not in ("body", "html"):
                tokens = value.split()
                label += "." + " ".join(sorted({t.translate(NO_DIGITS) for t in tokens}))
                marked |= marks and any(map(says_aside, tokens))
            elif name == "role" and marks:
                marked |= value in ROLES
                main |= value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                dropped = True
    return label, dropped, marked, main and not dropped


def own_text(top: Node) -> dict[int, int]:
    """Letters outside links of the elements in and under ``top``, without those of elements that are no text."""
    order, stack, sizes = [], [top], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.content if isinstance(x, Node)]
    for node in reversed(order):
        sizes[id(node)] = 0 if node.tag == "a" or node.dropped else sum([len(x.strip()) if isinstance(x, str) else sizes[id(x)] for x in node.content])
    return sizes


def settle(root: Node, mains: list[Node], marked: list[Node]) -> None:
    """Decides which of a page's main parts count and which of its marked elements are deleted; see the module's text."""
    outer = [x for x in mains if x.top is None and not x.hid]
    fewest = min((x.above for x in outer), default=0)
    kept = [x for x in outer if x.above == fewest]
    for x in mains:
        x.main = False
    open_: set[int] = set()  # not deleted, as they are kept parts or around one
    for x in kept:
        x.main = True
        node = x
        while node is not None and id(node) not in open_:
            open_.add(id(node))
            node = node.parent
    first: dict[int, list[Node]] = {}  # by region: its outermost marked elements
    under: dict[int, list[Node]] = {}  # by marked element: the next ones in it
    tops = {id(x): x for x in kept or [root]}
    for x in marked:
        if x.hid or id(x) in open_:
            continue
        if x.over is not None and id(x.over) not in open_:
            under.setdefault(id(x.over), []).append(x)
        elif kept and not (x.top is not None and x.top.main):
            x.dropped = True  # outside the kept parts they need leave nothing
        else:
            first.setdefault(id(x.top if kept else root), []).append(x)
    for key, some in first.items():
        sizes = own_text(tops[key])
        whole = sizes[key]
        # the largest first; every element is opened once at most
        heap = [(-sizes[id(x)], k, x) for k, x in enumerate(some)]
        heapq.heapify(heap)
        left, number = whole + sum(s for s, _, _ in heap), len(heap)
        while heap and left < MINOR * whole:
            size, _, x = heapq.heappop(heap)
            left -= size
            for y in under.get(id(x), ()):
                number += 1
                heapq.heappush(heap, (-sizes[id(y)], number, y))
                left -= sizes[id(y)]
        for _, _, x in heap:
            x.dropped = True


def tree(source: str, marks: bool = True) -> Node:
    """The element tree of a page; texts have their character references decoded."""
    from collections import Counter
    from html import unescape

    root = here = Node("", "", None, False, False, False)
    mains: list[Node] = []
    marked_ones: list[Node] = []
    standing: Counter[str] = Counter()  # open elements by tag, so that stray end tags needn't look for theirs

    def ended(node: Node) -> Node:
        nonlocal here
        while here is not node:
            standing[here.tag] -= 1
            here = here.parent
        standing[node.tag] -= 1
        return node.parent

    at = 0
    while True:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            here.content.append(unescape(text))
        if not m:
            settle(root, mains, marked_ones)
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if standing[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = ended(node)
            continue
        if tag in PARAGRAPH_ENDS and "p" in here.open:
            here = ended(here.open["p"])
        if tag in CLOSED_BY and tag in here.open:
            here = ended(here.open[tag])
        label, dropped, marked, main = read_marks(tag, m[3], marks)
        node = Node(tag, label, here, dropped, marked, main)
        here.content.append(node)
        if main:
            mains.append(node)
        if marked:
            marked_ones.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and (not m[3].endswith("/") or tag in BLOCKS):
            here = node
            standing[tag] += 1


def hashed(root: Node) -> list[Node]:
    """All elements, children first, with ``digest`` of their subtree, ``slot``, ``size`` and ``links``: letters, and letters in links, and
    ``prose``: whether paragraphs or headings are in it.

    A slot's structure is the set of the structures of the blocks in it, so pages with more or fewer paragraphs share it."""
    from xxhash import xxh3_64_intdigest

    def number(*parts: bytes) -> int:
        return xxh3_64_intdigest(b"\x00".join(parts)) - (1 << 63)

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.inside = node.parent is not None and (node.parent.inside or node.parent.main)
        stack += [x for x in node.content if isinstance(x, Node)]
    shapes: dict[int, tuple[int, ...]] = {}  # by element: the shapes that it gives its block
    for node in reversed(order):
        parts, shape = [node.tag.encode()], set()
        size = links = own = 0
        prose = node.tag in PROSE
        for x in node.content:
            if isinstance(x, Node):
                parts.append(b"\x01%d" % x.digest)
                if not x.dropped:
                    shape.update(shapes.pop(id(x)))
                    size += x.size
                    links += x.links
                    prose |= x.prose
            else:
                words = " ".join(x.split())
                parts.append(b"\x02" + words.encode("utf-8", "surrogatepass"))
                own += len(words)
        node.size, node.links, node.prose = size + own, size + own if node.tag == "a" else links, prose
        node.digest = number(*parts)
        if node.tag in BLOCKS:
            node.slot = number(node.label.encode("utf-8", "surrogatepass"), *(b"%d" % k for k in sorted(shape)))
            shapes[id(node)] = (node.slot,)
        else:
            node.slot = 0
            shapes[id(node)] = (*shape, 1) if node.tag == "a" else tuple(shape)
    paths = {id(root): b""}
    for node in order:  # parents first
        here = paths[id(node)]
        inner = b"%d" % number(here, node.label.encode("utf-8", "surrogatepass")) if node.tag in BLOCKS else here
        if node.tag in BLOCKS:
            node.slot = number(here, b"%d" % node.slot)
        for x in node.content:
            if isinstance(x, Node):
                paths[id(x)] = inner
    order.reverse()
    return order


def may_repeat(node: Node) -> bool:
    """Whether a subtree may be a template for its content: block elements with text outside the main part, and inside it link lists and bare containers."""
    if node.tag not in BLOCKS or node.tag in ("html", "body") or not node.size or node.main or node.dropped:
        return False
    return not node.inside or 2 * node.links >= node.size or not node.prose and node.tag in ("ul", "ol", "div", "section", "table")


def in_slots(node: Node) -> bool:
    return node.tag in CONTAINERS and node.size > 0 and not node.main and not node.inside and not node.dropped


def candidates(order: list[Node]) -> tuple[set[int], dict[int, int]]:
    """Hashes of the subtrees that may be templates for their content; and, of those that may be for their slot, or be a main part by
    it, the slots with the ``PARTS_OF_ONE``-ths of the page's own text that they hold."""
    found = {node.digest for node in order if may_repeat(node)}
    own = sum(root.size - root.links for root in order[-1:])
    slots: dict[int, int] = {}
    for node in order:
        if node.tag in CONTAINERS and not node.dropped and node.size:
            slots[node.slot] = slots.get(node.slot, 0) + (node.size - node.links)
    return found, {k: min(PARTS_OF_ONE, PARTS_OF_ONE * v // own) if own > 0 else 0 for k, v in slots.items()}


def recurs(n: str, pages: str) -> str:
    """SQL: whether ``n`` of a host's ``pages`` make a template."""
    return f"{n} >= greatest(2, least({ENOUGH}, {pages} / 2), least({LEAST_SHARE} * {pages}, sqrt({pages})))"


def known_templates(order: list[Node], contents: set[int], minor: set[int], main: set[int]) -> set[int]:
    """ids of the elements to delete, given a host's recurring contents, its recurring slots with little text, and its slots with the pages' text."""
    gone, holds, leaf = set(), set(), set()
    for node in order:  # children first: a main slot without another in it is innermost
        carries = node.slot in main and node.tag in CONTAINERS and not node.dropped
        if carries and id(node) not in holds:
            leaf.add(id(node))
        if node.parent is not None and (carries or id(node) in holds):
            holds.add(id(node.parent))
    own = [node for node in order if id(node) in leaf]
    some_stay = any(node.digest not in contents for node in own)
    kept: set[int] = set()  # inside an innermost main slot
    for node in reversed(order):
        if node.parent is not None and (id(node.parent) in leaf or id(node.parent) in kept):
            kept.add(id(node))
        if id(node) in holds:
            continue
        if may_repeat(node) and node.digest in contents:
            # one of several main parts may recur; inside a main slot it is as inside a marked article
            if id(node) in leaf:
                repeated = some_stay
            else:
                repeated = id(node) not in kept or 2 * node.links >= node.size or not node.prose and node.tag != "p"
            if repeated:
                gone.add(id(node))
        elif in_slots(node) and node.slot in minor and id(node) not in kept:
            gone.add(id(node))
    return gone


def main_text(source: str, contents: set[int] = frozenset(), minor: set[int] = frozenset(), main: set[int] = frozenset(), marks: bool = True) -> str:
    """The blocks of the page's main part, one a line."""
    root = tree(source, marks)
    gone = known_templates(hashed(root), contents, minor, main) if contents or minor else ()
    mains, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        if node.main:
            mains.append(node)
        else:
            stack += [x for x in reversed(node.content) if isinstance(x, Node)]
    blocks: list[str] = []
    run: list[str] = []

    def cut():
        words = " ".join("".join(run).split())
        run.clear()
        if words:
            blocks.append(words)

    for top in mains or [root]:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                cut()
            elif isinstance(x, str):
                run.append(x)
            elif x.dropped or id(x) in gone:
                run.append(" ")
            elif x.tag == "br" or x.tag in ("td", "th"):
                run.append(" ")
                todo += reversed(x.content)
            elif x.tag in BLOCKS:
                cut()
                todo += [None, *reversed(x.content)]
            else:
                todo += reversed(x.content)
        cut()
    return "\n".join(blocks)


def site_templates(pages: DataFrame, marks: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """host and contents, minor and main: the hashes of the subtrees that recur across its pages, of the recurring slots with little of their text, and of those with most of it.
    And host and salts of the hosts with over a ``HOT``-th of all html, so fewer than ``HOT``: to how many parts of about ``PART_BYTES``, or a ``PART_SHARE``-th, theirs is dealt.
    And the html's characters in all.

    A page counts once for each distinct html of a host, so copies and repeated rows make no templates of their own text.
    Hashes are distinct within a page and counted before they are shuffled by host and hash; a host's templates are gathered
    from partial sets, each of one task's hashes.
    """

    def emit(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            hosts, contents, found, places, shares, sizes = [], [], [], [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = source or ""
                hosts.append(urlfilter.split_url(url)[0])
                contents.append(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                own, slots = candidates(hashed(tree(source, marks)))
                found.append(sorted(own))
                places.append(sorted(slots))
                shares.append([slots[k] for k in places[-1]])
                sizes.append(len(source))
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((hosts, contents, found, places, shares, sizes), kinds, strict=True)], names=names)

    names = ["host", "content", "digests", "slots", "shares", "size"]
    own = pages.select("url", "html").mapInArrow(emit, "host string, content binary, digests array<long>, slots array<long>, shares array<long>, size long")
    own = own.groupBy("host", "content", "digests", "slots", "shares").agg(F.sum("size").alias("size"))
    # kind 0: the page itself, 1: a content, 2: a slot
    row = "named_struct('kind', {}, 'digest', {}, 'share', {})".format
    rows = f"concat(array({row(0, '0L', '0L')}), transform(digests, d -> {row(1, 'd', '0L')}), transform(slots, (d, i) -> {row(2, 'd', 'get(shares, i)')}))"
    each = own.select("host", "size", F.explode(F.expr(rows)).alias("x")).select("host", "size", "x.*")
    counts = common.staged(each.groupBy("host", "kind", "digest").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("share").alias("share")), "subtrees")
    sites = counts.where("kind = 0").select("host", F.col("n").alias("pages"), "size")
    total = sites.agg(F.sum("size")).first()[0] or 0
    part = max(1, min(PART_BYTES, total // PART_SHARE))
    hot = sites.where((F.col("size") > total / HOT) & (F.col("size") > part)).select("host", F.expr(f"cast(size div {part} as int) + 1").alias("salts"))

    many = common.spread_join(counts.where("kind > 0 and n > 1"), sites.select("host", "pages"), ["host"]).where(recurs("n", "pages"))
    share = f"share / n / {PARTS_OF_ONE}"
    role = F.expr(f"case when kind = 1 then 'contents' when {share} < {MINOR} then 'minor' when {share} >= {MAIN} then 'main' end")
    many = many.select("host", "digest", role.alias("role")).where("role is not null")
    sets = [F.collect_set(F.when(F.col("role") == r, F.col("digest"))).alias(r) for r in ROLES_OF]
    # a host's sets are gathered in two steps, so no task meets all the rows of one
    some = many.withColumn("deal", F.expr(f"pmod(xxhash64(digest), {DEAL})")).groupBy("host", "deal").agg(*sets)
    return some.groupBy("host").agg(*(F.flatten(F.collect_list(r)).alias(r) for r in ROLES_OF)), hot, total


def extract_text(pages: DataFrame, marks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    common.small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    host = F.when(F.instr("url", "://") > 0, common.lower_az(F.regexp_extract("url", "://([^/?#]*)", 1))).otherwise("")
    sites, hot, total = site_templates(pages, marks)
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    sites = sites.join(F.broadcast(hot), "host", "left").select(F.col("host").alias("site"), *ROLES_OF, F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("part"))
    rows = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host")).join(F.broadcast(hot), "host", "left")
    rows = rows.withColumn("salt", F.expr("cast(pmod(xxhash64(page_id, url, html), coalesce(salts, 1)) as int)"))
    none = {"page_id": kind, "url": "string", "html": "string"}
    known = sites.select(*(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.col("site").alias("host"), F.col("part").alias("salt"), *ROLES_OF)
    rows = rows.select(*none, "host", "salt", *(F.lit(None).cast("array<long>").alias(r) for r in ROLES_OF)).unionByName(known)
    # as many tasks as there are parts of html, however many the session asks for; a part's templates come once, ahead of its pages
    rows = rows.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", F.col("main").isNull())

    def extract(batches):
        import pyarrow as pa

        at, known = None, ()
        for batch in batches:
            keep, texts = [], []
            for k, (source, *part, contents, minor, main) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 8)), strict=True)):
                if main is not None:
                    at, known = part, (frozenset(contents), frozenset(minor), frozenset(main))
                    continue
                keep.append(k)
                texts.append(main_text(source or "", *(known if part == at else ()), marks=marks))
            own = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
