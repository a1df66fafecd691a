"""Main-text extraction by union-free regular-expression inference.

A page's tokens form a tree of labelled elements and text slots. Runs of like siblings fold into one repeated group;
two pages of a host are aligned child by child: what both have is aligned further, what one lacks becomes optional, texts
that differ become varying slots, texts that agree stay constant. The wrapper so inferred for a host (a union-free regular
expression over its tags) is merged in levels - within a task's batch, by salted host, by host - and only the partial wrappers
are shuffled.

The wrapper decides what a host's article is. Varying text outside links counts for an element, links and text that is
constant over the host's pages count against it; the element with the highest sum is the article. An ``article`` or ``main`` element
comes before others only if its own sum is nearly as high, or if the host has too few pages to tell. Of an article that is
not marked so, the constant and linked elements before its first and after its last varying child are template and are cut.
Nothing here recurses: pages of any depth are read.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._storage import materialise, plan_bytes
from corpusloom.operators.joins import join_counted

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the second kind ends when one of the first begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div section table td th ul ol dl main nav header footer form blockquote".split())
#: Elements, roles and words of class or id that are never part of an article.
DROP_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg canvas object audio video dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended widget pagination pager toolbar skip".split()
)
#: Within an article an element is dropped by a class or id only if every word of the name is one of DROP_WORDS or of these,
#: so "comment-list" goes and "market-share" stays. UNSURE words alone say too little there.
GENERIC = frozenset("area bar block box btn button buttons container count form group icon icons inner item items link links list outer panel row section thread title wrap wrapper".split())
UNSURE = frozenset("widget header".split())
#: A name with one of these says what an element holds or lacks, not what it is ("has-sidebar").
HOLDS = frozenset("has have with without no not hide show".split())
MAIN = frozenset("article main".split())
#: Elements that may be the article's container where none is marked.
CONTAINERS = frozenset("#root html body div section center table tbody tr td".split())
#: What a dropped element must hold to be taken for the article's container, and how many times the varying text of the rest.
TEXT_TAGS = frozenset("article main p h1 h2 h3".split())
VETO = 10
#: Text is template if it is the same on at least so many pages.
EVIDENCE = 3
#: The part of the highest sum that a marked element of a host with so many pages must have for its mark to count.
MARK = 0.95
#: Elements with more kinds of children have them merged by tag ("div.*"), and beyond as many tags into one kind ("*"): less
#: exact, but nothing is left out.
KINDS = 64
#: Plans of hosts up to so many bytes in all are broadcast.
BROADCAST = 32 << 20
#: Bytes of pages whose wrappers a task merges before they are shuffled.
PART = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = frozenset("class id role hidden aria-hidden".split())


class Node:
    """An element: ``tag``, ``label`` (tag and words of class, id and role), ``drop``, ``named`` (a word of its class or id is
    one of DROP_WORDS), ``sure`` (a whole class or id says so) and ``kids`` (elements and texts)."""

    __slots__ = ("tag", "label", "drop", "named", "sure", "kids")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.label, self.drop, self.named, self.sure, self.kids = tag, tag, tag in DROP_TAGS, False, False, []
        if attributes.strip():
            words = []
            for name, *values in ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name not in NAMES:
                    continue
                value = next((v for v in values if v), "").lower()
                if name == "role":
                    self.drop |= value in DROP_ROLES
                    words.append(value)
                elif name in ("class", "id"):
                    parts = re.findall(r"[a-z]+", value)
                    if not DROP_WORDS.isdisjoint(parts) and tag not in ("body", "html", "article", "main"):
                        for x in (set(re.findall(r"[a-z]+", v)) for v in value.split()):
                            if HOLDS.isdisjoint(x) and not DROP_WORDS.isdisjoint(x):
                                self.named = True
                                self.sure |= x <= DROP_WORDS | GENERIC and not x & DROP_WORDS <= UNSURE
                    words += parts
                elif name == "hidden" or value == "true":
                    self.drop = True
            if words:
                self.label = tag + "." + ".".join(sorted(set(words)))


def parse(text: str) -> Node:
    """The element tree of a page, forgiving of missing end tags, stray ones and cut-off pages."""
    root = Node("#root", "")
    stack = [root]
    opened: dict[str, int] = {}

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    for m in _tokens(text):
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                stack[-1].kids.append(token)
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "body", "main") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        if tag in BLOCK and opened.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in CLOSES and any(opened.get(t) for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag not in VOID and tag not in RAW and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _tokens(text: str) -> Iterator[re.Match]:
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        yield m
        at = m.end()
        if m[2] and not m[1] and (tag := m[2].lower()) in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            at = end.start() if end else n
            if end:
                at = text.find(">", at) + 1 or n


class Wrapper:
    """A part of an expression: an element with parts, or a text slot (label ``#``) with its ``chars``, those in ``links``, and
    ``const``, its text while that is the same on all ``pages``."""

    __slots__ = ("label", "optional", "repeated", "named", "pages", "chars", "links", "const", "kids")

    def __init__(self, label: str, named: bool = False, chars: int = 0, links: int = 0, const: str | None = None):
        self.label, self.optional, self.repeated, self.named, self.pages, self.chars, self.links, self.const, self.kids = label, False, False, named, 1, chars, links, const, []


Pairs = list[tuple[Wrapper, Wrapper, bool]]


def _short(text: str) -> str:
    return text if len(text) <= 80 else "\0" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _tag(label: str) -> str:
    return label.split(".", 1)[0]


def _fold(kids: list[Wrapper]) -> tuple[list[Wrapper], Pairs]:
    """Runs of like siblings, of one or two labels, as repeated groups, and which parts are to be aligned for that."""
    out: list[Wrapper] = []
    pairs: Pairs = []
    for k in kids:
        if out and out[-1].label == k.label:
            pairs.append((out[-1], k, True))
            out[-1].repeated = True
        elif len(out) > 2 and out[-2].label == k.label and out[-1].label == out[-3].label:
            last = out.pop()
            pairs += [(out[-2], last, True), (out[-1], k, True)]
            out[-1].repeated = out[-2].repeated = True
        else:
            out.append(k)
    for kind in (lambda k: _tag(k.label) + ".*", lambda k: "*"):
        if len(out) <= KINDS:
            break
        first: dict[tuple, Wrapper] = {}
        for k in out:
            key = ("#" if k.label == "#" else kind(k), k.named)
            if key in first:
                at = first[key]
                pairs.append((at, k, True))
                at.label, at.repeated, at.optional = key[0], True, True
            else:
                first[key] = k
        out = list(first.values())
    return out, pairs


def _matched(x: list[Wrapper], y: list[Wrapper]) -> tuple[list[Wrapper], Pairs]:
    """Parts of two pages in one order: a longest common subsequence of labels is aligned, the others become optional."""
    low = 0
    while low < min(len(x), len(y)) and x[low].label == y[low].label:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high].label == y[-1 - high].label:
        high += 1
    kids, pairs = x[:low], [(p, q, False) for p, q in zip(x[:low], y)]
    p, q = x[low : len(x) - high], y[low : len(y) - high]
    n, m = len(p), len(q)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i].label == q[j].label else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and p[i].label == q[j].label:
            kids.append(p[i])
            pairs.append((p[i], q[j], False))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            p[i].optional = True
            kids.append(p[i])
            i += 1
        else:
            q[j].optional = True
            kids.append(q[j])
            j += 1
    kids += x[len(x) - high :]
    return kids, pairs + [(x[len(x) - k], y[len(y) - k], False) for k in range(high, 0, -1)]


def _align(pairs: Pairs) -> None:
    """Take the second of each pair into the first, in order. Parts that this brings together are aligned later, in the order
    in which they met, so each is whole before it is taken into another."""
    todo = deque(pairs)
    while todo:
        a, b, same_page = todo.popleft()
        a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
        a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
        if a.label == "#":
            a.chars, a.links = a.chars + b.chars, a.links + b.links
            both = a.const is not None and b.const is not None
            a.const = _short(f"\0{a.const}\0{b.const}" + " " * 80) if same_page and both else a.const if a.const == b.const else None
            continue
        kids, more = (a.kids + b.kids, []) if same_page and not (a.kids and b.kids) else _matched(a.kids, b.kids)
        a.kids, folded = _fold(kids)
        todo.extend((p, q, same_page or same) for p, q, same in more + folded)


def wrap(root: Node) -> Wrapper:
    """The expression of one page."""
    top = Wrapper(root.label)
    stack = [(top, root.tag == "a", iter(root.kids))]
    while stack:
        w, linked, kids = stack[-1]
        for k in kids:
            if isinstance(k, str):
                if text := k.strip():
                    w.kids.append(Wrapper("#", False, len(text), len(text) * linked, _short(text)))
            elif not (k.drop or k.tag in RAW):
                w.kids.append(Wrapper(k.label, k.named))
                stack.append((w.kids[-1], linked or k.tag == "a", iter(k.kids)))
                break
        else:
            w.kids, pairs = _fold(w.kids)
            _align(pairs)
            stack.pop()
    return top


def merge(wrappers: Iterable[Wrapper]) -> Wrapper | None:
    """The expression of all pages of the given ones, of which the first takes the others in."""
    out = None
    for w in wrappers:
        if out is None:
            out = w
        else:
            _align([(out, w, False)])
    return out


def _walk(w: Wrapper, into=lambda k: True) -> Iterator[tuple[Wrapper, int]]:
    """The parts in order with their depths, below those that ``into`` accepts."""
    stack = [(w, 0)]
    while stack:
        k, depth = stack.pop()
        yield k, depth
        if into(k):
            stack += [(c, depth + 1) for c in reversed(k.kids)]


def dumps(w: Wrapper) -> str:
    """The wrapper as flat JSON: each part, in order, with the number of its parts."""
    return json.dumps([[k.label, k.optional + 2 * k.repeated + 4 * k.named, k.pages, *((k.chars, k.links, k.const) if k.label == "#" else (len(k.kids),))] for k, _ in _walk(w)], ensure_ascii=False)


def loads(text: str) -> Wrapper:
    top: list[Wrapper] = []
    open_: list[list] = []
    for label, flags, pages, *rest in json.loads(text):
        w = Wrapper(label, flags >= 4)
        w.optional, w.repeated, w.pages = bool(flags & 1), bool(flags & 2), pages
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][1] -= 1
            open_[-1][0].kids.append(w)
        else:
            top.append(w)
        if label == "#":
            w.chars, w.links, w.const = rest
        else:
            open_.append([w, rest[0]])
    return top[0]


def expression(w: Wrapper) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    out: list[str] = []
    stack: list[Wrapper | str] = [w]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        group = k.optional or k.repeated
        end = f"){'+' if k.repeated else ''}{'?' if k.optional else ''}" if group else ""
        out.append("(" if group else "")
        if k.label == "#":
            out.append(("#TEXT" if k.const is None or k.const.startswith("\0") else k.const) + end)
        else:
            out.append(f"<{k.label}>")
            stack += ["</>" + end, *reversed(k.kids)]
    return "".join(out)


def _slot(k: Wrapper) -> int:
    """What a slot counts for its elements: links and template against them."""
    if k.const is not None and k.pages >= EVIDENCE:
        return -k.chars
    return k.chars - 2 * k.links


def _scores(w: Wrapper, keep: set[str]) -> dict[int, int]:
    """The score of every part, by ``id``; what is dropped by name counts for nothing outside itself unless kept."""
    order = [k for k, _ in _walk(w)]
    out: dict[int, int] = {}
    for k in reversed(order):
        out[id(k)] = _slot(k) if k.label == "#" else sum(out[id(c)] for c in k.kids if not c.named or c.label in keep)
    return out


def _varying(w: Wrapper, into) -> int:
    return sum(k.chars - k.links for k, _ in _walk(w, into) if k.label == "#" and (k.const is None or k.pages < 2))


def vetoed(w: Wrapper) -> set[str]:
    """Labels of elements that stay whatever their names: each holds text containers and over VETO times the varying text
    that would be left without it."""
    keep: set[str] = set()
    shown = lambda k: not k.named or k.label in keep
    while True:
        rest = sum(k.chars - k.links for k, _ in _walk(w, shown) if k.label == "#" and (k.const is None or k.pages < 2))
        tops = [k for k, _ in _walk(w, shown) if not shown(k) and any(_tag(c.label) in TEXT_TAGS for c, _ in _walk(k))]
        top = max(tops, key=lambda k: _varying(k, lambda c: True), default=None)
        if top is None or _varying(top, lambda c: True) <= VETO * rest:
            return keep
        keep.add(top.label)


def plan(w: Wrapper) -> dict:
    """What a wrapper says of its host's pages: ``path`` (labels from the root to the article), ``keep`` (names that drop
    nothing there) and ``cut`` (the article's parts in order, with whether they are repeated and whether they are template)."""
    keep = vetoed(w)
    score = _scores(w, keep)
    may = [k for k, _ in _walk(w, lambda k: not k.named or k.label in keep) if k.label != "#" and not (k.named and k.label not in keep) and score[id(k)] > 0]
    may = [k for k in may if _tag(k.label) in MAIN or _tag(k.label) in CONTAINERS and not k.repeated or "-" in _tag(k.label)]
    # Where there is evidence, a mark only counts with nearly as high a sum as the best has.
    least = MARK * max((score[id(k)] for k in may), default=0) if w.pages >= EVIDENCE else 0
    able = {id(k) for k in may}
    best, path, trail = None, [], []
    for k, depth in _walk(w, lambda k: not k.named or k.label in keep):
        trail[depth:] = [k]
        if id(k) in able:
            rank = (_tag(k.label) in MAIN and score[id(k)] >= least, score[id(k)], depth)
            if best is None or rank > best[0]:
                best, path = (rank, k), [x.label for x in trail[1:]]
    if best is None:
        return {"path": [], "keep": sorted(keep), "cut": []}
    kids = best[1].kids
    good = [i for i, k in enumerate(kids) if score[id(k)] > 0 and (not k.named or k.label in keep)]
    edge = lambda i: not best[0][0] and good and not good[0] <= i <= good[-1]
    cut = [[k.label, k.repeated, bool(edge(i) and score[id(k)] < 0 and _tag(k.label) in BLOCK)] for i, k in enumerate(kids) if k.label != "#"]
    return {"path": path, "keep": sorted(keep), "cut": cut if any(c[2] for c in cut) else []}


def _is(label: str, node: Node) -> bool:
    return label == node.label or label == "*" or label == node.tag + ".*"


def _find(root: Node, path: list[str], keep: set[str]) -> list[Node]:
    found = [root]
    for label in path:
        found = [k for f in found for k in f.kids if isinstance(k, Node) and not k.drop and _is(label, k) and (not k.named or _kept(k, keep))]
    return found


def _kept(k: Node, keep: set[str]) -> bool:
    return k.label in keep or k.tag + ".*" in keep or "*" in keep


def _template(node: Node, cut: list[list]) -> set[int]:
    """Which children, by ``id``, the wrapper's parts match that are template. A repeated part matches on."""
    out, at = set(), 0
    for k in node.kids if cut else ():
        if isinstance(k, Node) and not k.drop and k.tag not in RAW:
            for j in range(at, len(cut)):
                if _is(cut[j][0], k):
                    at = j if cut[j][1] else j + 1
                    if cut[j][2]:
                        out.add(id(k))
                    break
    return out


def article(root: Node, by: dict) -> str:
    """The text of the elements at the path of a plan, of the page's own article where the path leads nowhere."""
    keep = set(by["keep"])
    found = _find(root, by["path"], keep)
    if not found:
        by = plan(wrap(root))
        keep |= set(by["keep"])
        found = _find(root, by["path"], keep) or [root]
    blocks: list[list[str]] = [[]]
    for f in found:
        gone = _template(f, by["cut"])
        blocks.append([])
        stack = [(iter(f.kids), f.tag in MAIN, False)]
        while stack:
            kids, inside, block = stack[-1]
            for k in kids:
                if isinstance(k, str):
                    blocks[-1].append(k)
                elif k.tag == "br":
                    blocks[-1].append(" ")
                elif not (k.drop or k.sure and not _kept(k, keep) or k.tag in RAW or k.tag == "header" and not inside or id(k) in gone):
                    if k.tag in BLOCK:
                        blocks.append([])
                    stack.append((iter(k.kids), inside or k.tag in MAIN, k.tag in BLOCK))
                    break
            else:
                stack.pop()
                if block:
                    blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches, 1, PART):
        hosts: dict[str, Wrapper] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = wrap(parse(page or ""))
            hosts[host] = merge([hosts[host], w]) if host in hosts else w
        yield pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array(list(map(dumps, hosts.values())), pa.string())], names=["host", "wrapper"])


def _merged(table: pa.Table) -> pa.Table:
    out = merge(map(loads, sorted(table.column("wrapper").to_pylist())))
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [dumps(out)]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def _host(url_col: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper)``: the wrapper of every host (see ``loads``, ``expression`` and ``plan``). Pages without a URL share the
    host ''. Partial wrappers of 16 MB of pages each are merged in two steps, of a host as many in the one as in the other."""
    parts = pages.select(_host(url_col).alias("h"), F.col(html_col).cast("string").alias("p")).mapInArrow(_partial, "host string, wrapper string")
    salts = max(16, math.isqrt(plan_bytes(pages) // PART))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    parts = parts.groupBy("host", "salt").applyInArrow(lambda t: _merged(t.select(["host", "wrapper"])), "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(_merged, "host string, wrapper string")


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [loads(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([json.dumps(plan(w), ensure_ascii=False) for w in found], pa.string()), pa.array([w.pages for w in found], pa.int64())], names=["host", "plan", "n"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[str, dict] = {}
    for batch in _text.slices(batches, 2):
        texts = []
        for page, by in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if by not in plans:
                plans = {by: json.loads(by)} | (plans if len(plans) < 1000 else {})
            texts.append(article(parse(page or ""), plans[by]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for each row: the article's blocks in page order, white space within a block
    as one space, joined by line breaks. A null or empty page has an empty text. Nulls and repeats in the other columns
    pass through. A page that lacks its host's article element is read by its own wrapper, at worst as a whole.

    Pages do not move: the hosts' plans, whose size is added up first, are broadcast. Beyond BROADCAST bytes, those of the most
    frequent hosts are, and the pages of the others are shuffled by host."""
    kinds = dict(pages.dtypes)
    plans = materialise(wrappers(pages, url_col, html_col).mapInArrow(_plans, "host string, plan string, n long"), "plans")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("page"), _host(url_col).alias("host"))
    size = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("host"))).first()[0] or 0
    rows = rows.join(F.broadcast(plans), "host") if size <= BROADCAST else join_counted(rows, plans, "host", "n")
    out = rows.select("id", "url", "page", "plan").mapInArrow(_extracted, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
