"""Main-text extraction by wrapper induction over pages of the same host.

Pages become small DOM trees in which a run of like siblings is one node. Every
task aligns the trees of its pages, host by host, with simple tree matching and
keeps one template per host: for each node how many pages have it and how
many each of its texts. No node goes before the counts of all pages are in: a
template is as large as the different structure of its host, and so is the work. Templates of one host merge by the same matching,
first within salted parts, then across them, so no task sees a host's pages
together. Each page is then aligned with its host's template: nodes whose text
is the same on nearly all pages are template, slots that vary are content.
Elements that are page furniture by their tag, role or class never are content.

Defined results
    * null or empty html, or no content: empty text, 0 characters.
    * a page whose host has few pages, or no url, is judged by tags alone.
    * where a page has an article or main element, only what lies in it can be
      content; the template decides what of it is.
    * rows with the same html have one vote on the template of their host.
    * a page that shares half or more of its text (of its article, where it has
      one) with nearly all pages of its host is a near copy and judged by tags
      alone too: its furniture stays, its content does not go.
    * character references are decoded within one run of text, never across tags.
    * unclosed and cut-off markup is closed where HTML would close it.
    * elements nested more than MAX_DEPTH deep are put side by side at that depth.
    * repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A node is template if it was seen on this many pages and was the same on this share of them.
MIN_PAGES = 8
SAME_SHARE = 0.9
SALT = 32
#: Texts counted for each node. A text that all but a share x of the pages have is undercounted by x / 64 at most.
TEXTS = 64
#: Elements nest this deep at most, as browsers bound it too; deeper ones are siblings, their text stays in place.
MAX_DEPTH = 256
#: Nodes of partial templates that a task holds before it hands them on.
HELD_NODES = 200_000

# fixed values: element and class vocabularies
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea "
    "input option svg canvas object dialog menu audio video".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "comment comments reply replies respond disqus widget pagination pager toolbar login signup "
    # whole tokens only: these compounds are furniture, others may be wrappers such as has-sidebar
    "ad-banner ad-slot ad-container ad-unit cookie-banner cookie-notice cookie-consent nav-menu nav-bar nav-links "
    "main-nav main-menu site-nav site-footer page-footer site-navigation share-buttons social-share social-links "
    "related-posts related-articles comments-area comment-list comment-form sidebar-left sidebar-right".split()
)
#: Dropped only outside an article: an article may have a head of its own.
OUTER_WORDS = frozenset("header masthead topbar site-header page-header".split())
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = frozenset("html body table ul ol dl div article section main td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "sig", "kids", "drop", "outer", "word", "head", "count", "texts", "text")

    def __init__(self, tag, sig="", drop=False, outer=False):
        self.tag, self.sig, self.drop, self.outer = tag, sig, drop, outer
        self.word = self.head = False  # by a word of class or id: furniture, or so outside an article
        self.kids: list = []  # Nodes and strings
        self.count, self.text = 1, None
        self.texts: dict | None = None  # pages by checksum, in templates


def _judged(tag: str, attrs: str) -> Node:
    drop, outer, sig, hidden, words = tag in DROPPED, tag == "header", tag, False, set()
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden":
                hidden = True
            elif name == "role":
                drop = drop or value in FURNITURE_ROLES
            elif name in ("class", "id"):
                words.update(value.split())
                if name == "class":
                    sig = f"{tag}.{'.'.join(sorted(value.split()))}"
    out = Node(tag, sig, drop or hidden, outer)
    out.word, out.head = bool(words & FURNITURE_WORDS), bool(words & OUTER_WORDS)
    return out


def _settled(node: Node) -> bool:
    """Drop nodes by their words unless an article lies in them; whether one is in this node."""
    holds = False
    for x in node.kids:
        if not isinstance(x, str):
            holds = _settled(x) or holds
    if node.tag in ("article", "main"):
        holds = holds or not node.word
    elif node.tag not in ("html", "body") and not holds:
        node.drop, node.outer = node.drop or node.word, node.outer or node.head
    return holds and not node.drop


def parse(source: str) -> Node:
    """A DOM tree good enough for text: implied ends, void and raw-text elements, cut-off input."""
    root = Node("#root", "#root")
    stack, at, n = [root], 0, len(source)
    deep: list[Node] = []  # open elements below MAX_DEPTH
    hidden = 0  # how many of them are furniture
    find = _TOKEN.search
    while at < n:
        m = find(source, at)
        if m is None:
            if not hidden:
                stack[-1].kids.append(source[at:])
            break
        if m.start() > at and not hidden:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(4) == "":  # cut off inside a tag
            break
        if m.group(1) and any(x.tag == tag for x in reversed(deep)):
            while True:
                x = deep.pop()
                hidden -= x.drop or x.word
                if x.tag == tag:
                    break
            if tag in BLOCK:
                stack[-1].kids.append(Node(tag, tag))
            continue
        if m.group(1):
            deep, hidden = [], 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in BLOCK and not deep:
            _close(stack, {"p"}, BLOCK - {"p"})
        if tag in IMPLIED_END and not deep:
            _close(stack, IMPLIED_END[tag], SCOPE)
        node = _judged(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if tag in ("title", "textarea"):
                node.kids.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or not m.group(3).endswith("/")):
            if len(stack) < MAX_DEPTH:
                stack.append(node)
            else:
                deep.append(node)
                hidden += node.drop or node.word
    _settled(root)
    return root


def _close(stack, tags, scope) -> None:
    """Close open elements named in ``tags``, looking no further up than ``scope``."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _text_of(node: Node) -> str:
    return "".join(x if isinstance(x, str) else " " + _text_of(x) for x in node.kids)


def skeleton(node: Node) -> Node:
    """The tree with runs of like siblings folded, and a checksum of the text each node has itself."""
    out = Node(node.tag, node.sig, node.drop, node.outer)
    own = " ".join("".join(x for x in node.kids if isinstance(x, str)).split())
    out.text = zlib.crc32(own.encode("utf-8", "replace")) if own else 0
    for x in node.kids:
        if isinstance(x, str):
            continue
        if out.kids and out.kids[-1].sig == x.sig:
            last = out.kids[-1]
            last.text = zlib.crc32(_text_of(x).encode("utf-8", "replace"), last.text)
            last.kids = []
        else:
            out.kids.append(skeleton(x))
    return out


class Matching:
    """Simple tree matching of trees whose equal shapes are one: signatures all the way down.

    A score is worked out once for each pair of shapes, not of nodes. Children
    that have the same shape at both ends of two lists match each other in some
    best alignment, so only what is left between them is aligned, row by row over
    the codes of the other side, and of the rows only every ROWS-th is kept: the
    way back works out the rows between two of them again.
    """

    ROWS = 256

    def __init__(self):
        self.codes: dict = {}  # (signature, shapes of the children) -> shape
        self.shapes: list = []
        self.sizes: list[int] = []
        self.scores: dict = {}
        self.known: dict[int, tuple] = {}

    def shape(self, node: Node) -> int:
        if id(node) in self.known:
            return self.known[id(node)][1]
        key = (node.sig, tuple([self.shape(x) for x in node.kids]))
        code = self.codes.get(key)
        if code is None:
            code = self.codes[key] = len(self.shapes)
            self.shapes.append(key)
            self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
        self.known[id(node)] = (node, code)  # the node is held, so that no other gets its id
        return code

    def score(self, x: int, y: int) -> int:
        """Nodes that two shapes have in common, matched in order; 0 if their signatures differ."""
        if x == y:
            return self.sizes[x]
        if self.shapes[x][0] != self.shapes[y][0]:
            return 0
        key = (x, y)
        if key not in self.scores:
            self.scores[key] = 1 + self._aligned(self.shapes[x][1], self.shapes[y][1])[0]
        return self.scores[key]

    def pairs(self, a: Node, b: Node) -> list[tuple[int, int]]:
        """Positions of matched children of two nodes; none if their signatures differ."""
        x, y = self.shape(a), self.shape(b)
        if self.shapes[x][0] != self.shapes[y][0]:
            return []
        return self._aligned(self.shapes[x][1], self.shapes[y][1], True)[1]

    def _aligned(self, a: tuple, b: tuple, trace: bool = False):
        lo, hi = 0, min(len(a), len(b))
        while lo < hi and a[lo] == b[lo]:
            lo += 1
        end = 0
        while end < hi - lo and a[-1 - end] == b[-1 - end]:
            end += 1
        n, m = len(a) - end, len(b) - end
        total = sum(self.sizes[c] for c in a[:lo]) + sum(self.sizes[c] for c in a[n:])
        sig = lambda c: self.shapes[c][0]
        # children that no child of the other has the signature of match nothing
        both = {sig(c) for c in a[lo:n]} & {sig(c) for c in b[lo:m]}
        left = [i for i in range(lo, n) if sig(a[i]) in both]
        right = [j for j in range(lo, m) if sig(b[j]) in both]
        middle, found = self._between([a[i] for i in left], [b[j] for j in right], trace) if left and right else (0, [])
        if not trace:
            return total + middle, ()
        ends = [(i, i) for i in range(lo)], [(n + k, m + k) for k in range(end)]
        return total + middle, [*ends[0], *((left[i], right[j]) for i, j in found), *ends[1]]

    def _between(self, a: list, b: list, trace: bool):
        import numpy as np

        kinds, place = np.unique(np.array(b), return_inverse=True)
        kinds, n = kinds.tolist(), len(a)
        weights: dict[int, np.ndarray] = {}

        def below(row, x):
            """The next row of best scores, after one more child of shape x."""
            if x not in weights:
                weights[x] = np.array([self.score(x, y) for y in kinds], np.int32)
            w = weights[x][place]
            best = np.where(w > 0, row[:-1] + w, 0)
            return np.maximum.accumulate(np.concatenate([row[:1], np.maximum(row[1:], best)]))

        row, kept = np.zeros(len(b) + 1, np.int32), []
        for i, x in enumerate(a):
            if trace and i % self.ROWS == 0:
                kept.append(row)
            row = below(row, x)
        if not trace:
            return int(row[-1]), []
        found, j = [], len(b)
        for k in range(len(kept) - 1, -1, -1):
            first, rows = k * self.ROWS, [kept[k]]
            for x in a[first : first + self.ROWS]:
                rows.append(below(rows[-1], x))
            i = min(self.ROWS, n - first)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((first + i, j))
        return int(row[-1]), found[::-1]


def merge(a: Node, b: Node) -> Node:
    """Add template ``b`` to template ``a``: matched nodes count together, others are kept."""
    return _merged(a, b, Matching())


def _merged(a: Node, b: Node, matching: Matching) -> Node:
    pairs = matching.pairs(a, b)
    a.texts = _counted(_texts(a), _texts(b))
    a.count += b.count
    taken, kids, j0 = dict(pairs), [], 0
    for i, x in enumerate(a.kids):
        if i in taken:
            j = taken[i]
            kids += b.kids[j0:j]
            kids.append(_merged(x, b.kids[j], matching))
            j0 = j + 1
        else:
            kids.append(x)
    a.kids = kids + b.kids[j0:]
    return a


def _texts(node: Node) -> dict:
    return {node.text: 1} if node.texts is None else node.texts


def _counted(a: dict, b: dict) -> dict:
    """Sums of two counts; beyond TEXTS entries the next largest count is taken off all (Misra and Gries)."""
    out = dict(a)
    for text, n in b.items():
        out[text] = out.get(text, 0) + n
    if len(out) > TEXTS:
        off = sorted(out.values(), reverse=True)[TEXTS]
        out = {text: n - off for text, n in out.items() if n > off}
    return out


def usable(node: Node) -> Node:
    """The finished template of a host without nodes, and with them their children, of fewer than MIN_PAGES pages."""
    node.kids = [usable(x) for x in node.kids if x.count >= MIN_PAGES]
    return node


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.kids))


def dumps(node: Node) -> list:
    return [node.sig, sorted(_texts(node).items()), node.count, [dumps(x) for x in node.kids]]


def loads(data: list) -> Node:
    out = Node(data[0].split(".")[0], data[0])
    out.texts, out.count = {t: n for t, n in data[1]}, data[2]
    out.text = max(out.texts, key=out.texts.get, default=None)
    out.kids = [loads(x) for x in data[3]]
    return out


def _constant(t: Node) -> bool:
    return bool(t.text) and t.count >= MIN_PAGES and t.texts[t.text] >= SAME_SHARE * t.count


def main_text(source: str | None, template: Node | None = None) -> str:
    """The content blocks of a page, joined by line ends."""
    if not source:
        return ""
    root = parse(source)
    mains = _mains(root)
    blocks: list[list[str]] = [[]]
    in_template: set[int] = set()
    if template is not None:
        _mark(template, root, in_template)
    shared = total = 0

    def walk(node: Node, inside: bool) -> None:
        nonlocal shared, total
        if node.drop or (node.outer and not inside):
            return
        inside = inside or node.tag in ("article", "main")
        block = node.tag in BLOCK
        if block:
            blocks.append([])
        elif node.tag == "br":
            blocks[-1].append(" ")
        same = id(node) in in_template
        skip = same or (mains and not inside)
        for x in node.kids:
            if isinstance(x, str):
                n = 0 if mains and not inside else len(x) - x.count(" ")
                total += n
                shared += n if same else 0
                if not skip:
                    blocks[-1].append(html_lib.unescape(x))
            else:
                walk(x, inside)
        if block:
            blocks.append([])

    walk(root, False)
    texts = (" ".join("".join(b).split()) for b in blocks)
    if shared and 2 * shared >= total:
        return main_text(source)
    return "\n".join(t for t in texts if t)


def _mains(node: Node) -> bool:
    return any(
        not isinstance(x, str) and not x.drop and (x.tag in ("article", "main") or _mains(x))
        for x in node.kids
    )


def _mark(template: Node, root: Node, found: set[int]) -> None:
    """Ids of page nodes that the template shows to be constant."""
    folded = skeleton(root)
    matching = Matching()

    def walk(t: Node, s: Node, p: Node) -> None:
        if _constant(t) and t.text == s.text:
            found.add(id(p))
        runs: list[list[Node]] = []
        for x in p.kids:
            if isinstance(x, str):
                continue
            if runs and runs[-1][0].sig == x.sig:
                runs[-1].append(x)
            else:
                runs.append([x])
        for i, j in matching.pairs(t, s):
            if len(runs[j]) == 1:
                walk(t.kids[i], s.kids[j], runs[j][0])
            elif _constant(t.kids[i]) and t.kids[i].text == s.kids[j].text:
                for x in runs[j]:
                    _all(x, found)

    walk(template, folded, root)


def _all(node: Node, found: set[int]) -> None:
    found.add(id(node))
    for x in node.kids:
        if not isinstance(x, str):
            _all(x, found)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


TEMPLATE_SCHEMA = "host string, part int, template string"


def induce(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, html): partial templates per task, merged in two rounds."""

    def partial(batches):
        kept: dict[str, Node] = {}
        held = 0
        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                source, host = source.as_py(), host.as_py()
                if source:
                    tree = skeleton(parse(source))
                    held += _size(tree)
                    kept[host] = merge(kept[host], tree) if host in kept else tree
                if len(kept) >= 5_000:
                    yield _template_rows(kept)
                    kept, held = {}, 0
                elif held >= HELD_NODES:
                    held = sum(map(_size, kept.values()))
                    if held >= HELD_NODES // 2:
                        yield _template_rows(kept)
                        kept, held = {}, 0
        if kept:
            yield _template_rows(kept)

    first = pages.filter(F.col("host") != "").mapInArrow(partial, TEMPLATE_SCHEMA)

    def merged(pdf, last):
        out = None
        for x in sorted(pdf["template"]):
            tree = loads(json.loads(x))
            out = tree if out is None else merge(out, tree)
        return pdf.iloc[:1].assign(template=json.dumps(dumps(usable(out) if last else out)))

    some = first.groupBy("host", "part").applyInPandas(lambda pdf: merged(pdf, False), TEMPLATE_SCHEMA)
    return some.groupBy("host").applyInPandas(lambda pdf: merged(pdf, True), TEMPLATE_SCHEMA).select("host", "template")


def _distinct(d: DataFrame) -> DataFrame:
    """(host, html), the pages of a host that are equal byte by byte once. Only pages that occur again are grouped."""
    d = d.filter("host != '' AND html != ''").select("host", "html", F.sha1("html").alias("sha1"))
    again = d.groupBy("host", "sha1").count().filter("count > 1").drop("count")
    again = written(again, "html-repeats")
    once = d.join(again, ["host", "sha1"], "left_anti").select("host", "html")
    one = d.join(again, ["host", "sha1"], "left_semi").groupBy("host", "sha1").agg(F.first("html").alias("html"))
    return once.unionByName(one.select("host", "html"))


def _template_rows(kept: dict):
    hosts = list(kept)
    texts = [json.dumps(dumps(kept[h])) for h in hosts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hosts, pa.string()),
            pa.array([zlib.crc32(x.encode()) % SALT for x in texts], pa.int32()),
            pa.array(texts, pa.string()),
        ],
        names=["host", "part", "template"],
    )


def extract(pages: DataFrame, key="page_id", url="url", html="html") -> DataFrame:
    """(key, url, text, n_chars) per row."""
    d = pages.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    ).withColumn("host", _host(F.col("url")))
    templates = written(induce(_distinct(d)), "html-templates")
    d = d.join(templates, "host", "left").select(key, "url", "html", "template")
    kind = d.schema[key].dataType.simpleString()

    def run(batches):
        cache: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for source, t in zip(batch.column(2), batch.column(3), strict=True):
                t = t.as_py()
                if t is not None and t not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[t] = loads(json.loads(t))
                texts.append(main_text(source.as_py(), cache.get(t)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=[key, "url", "text"],
            )

    out = d.mapInArrow(run, f"`{key}` {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
