"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements; text of inline elements belongs to the block around them, and a run of
sibling elements of the same shape counts as one. The trees of a host are aligned by simple tree matching with the
tree of one of its pages; nodes without a partner there are aligned with each other by the labels on their path from
the root. An aligned node is a slot. The wrapper of a host says which slots and texts are template:

* a text is template if the posterior share of the pages that have it at its slot is above one half (above
  ``article_share`` of the host's pages inside an article element), with two pages' worth of prior;
* a slot outside articles is template if its texts come from a small stock, by the counts of its host or by those of
  all hosts that have a slot with the same path (adverts, footers and menus that change from page to page);
* a slot is template if its label says so: elements that HTML itself sets apart, and block elements one of whose whole
  class, id or role names is that of such a part. Inside articles a varying comment or teaser differs in nothing else.

All else varies with the page and is content, inside an article element or not. Article elements are a prior: where
they hold most of a page's text, a text outside them that no second page can confirm counts as template.

Skeletons and hashes of texts are what is shuffled; alignments are computed once per pair of skeletons.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, Store, small

# Fixed values of HTML: elements without content, raw text elements, elements closed by a like sibling.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp"
CLOSED_BY = {"p": "p", "li": "li", "option": "option", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd"}
BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
ENDS_P = BLOCKS - {"br", "html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "caption", "legend", "summary", "figcaption"}
# Elements that are never main text, and names of class, id or role of such parts.
APART = frozenset("head nav footer aside form button select script style noscript template iframe svg math object canvas dialog menu textarea title noembed noframes xmp".split())
NAMES = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal overlay newsletter subscribe sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments reply replies disqus login signup search pagination pager toolbar widget".split())
ARTICLE = frozenset(["article", "main"])
#: Elements whose names say something of their text and not of a part of the page.
TEXT_ONLY = frozenset("p h1 h2 h3 h4 h5 h6 html body main blockquote pre td th dd dt".split())
#: Elements that an unclosed paragraph, item or cell outside them does not reach into.
CONTAINERS = frozenset("ul ol table dl select div article section main td th body".split())
#: Deeper elements count as children of the element at this depth, as in browsers.
DEEPEST = 200
PLAIN, IN_ARTICLE, NAMED = 0, 1, 2

_VALUES = r"(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|(?P<cut>\Z))|<[!?][^>]*>|<(?P<raw>{RAW})\b{_VALUES}>.*?(?:</(?P=raw)\s*>|(?P<cut_raw>\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>{_VALUES})>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_SAFE = str.maketrans("()", "[]")


class Page:
    """The tree of block elements in document order (labels, parents, kinds) and the pieces of text by element.

    ``pieces`` are (element, text); ``breaks`` says before which of them a block begins. Nothing below a named element
    is in the tree: its texts are those of the element. ``names`` false takes no notice of names and of ``APART``.
    """

    def __init__(self, source: str | None, names: bool = True):
        self.labels, self.parents, self.kinds = ["#"], [-1], [PLAIN]
        self.pieces: list[tuple[int, list[str]]] = []
        self.breaks: list[int] = []
        source = source or ""
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements with the tree's element around their text
        opened: Counter = Counter()
        at, node, fresh = 0, 0, True

        def close(depth: int) -> int:
            for tag, _ in stack[depth:]:
                opened[tag] -= 1
            del stack[depth:]
            return stack[-1][1]

        stop = source.rfind(">") + 1  # what follows holds no tag, and only text unless a comment or raw text is open
        swallowed = False
        for m in _TOKEN.finditer(source, 0, stop):
            if m.start() > at:
                fresh = self.text(node, source[at : m.start()], fresh)
            at = m.end()
            tag, attributes = (m["tag"] or "").lower(), m["attributes"]
            if not tag:
                swallowed = m["cut"] is not None or m["cut_raw"] is not None
                continue  # comments and raw text are no page text
            block = tag in BLOCKS
            if block:
                fresh = True
            if m["end"]:
                if opened[tag]:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    node = close(depth)
                continue
            closes = CLOSED_BY.get(tag, "").split()
            if tag in ENDS_P:
                closes.append("p")
            if any(opened[c] for c in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    own = stack[depth][0]
                    if own in closes:
                        node = close(depth)
                        break
                    if own in CONTAINERS:
                        break
            if tag in VOID or attributes.endswith("/"):
                continue
            if len(stack) < DEEPEST and self.kinds[node] != NAMED:
                node = self.element(tag, attributes, node, block, names)
            stack.append((tag, node))
            opened[tag] += 1
        rest = "" if swallowed and at == stop else source[at:].split("<!--")[0]
        if rest:
            self.text(node, rest, fresh)

    def element(self, tag: str, attributes: str, parent: int, block: bool, names: bool) -> int:
        """Add an element to the tree, if it is one of its own; the element that its text belongs to."""
        found = [w for a, v in _ATTR.findall(attributes) for w in v.strip("\"'").split()] if attributes else []
        lower = {w.lower() for w in found}
        kind = self.kinds[parent]
        if names and (tag in APART or (tag == "header" and kind != IN_ARTICLE) or (lower & NAMES and tag not in TEXT_ONLY) or (attributes and _HIDDEN.search(attributes))):
            kind = NAMED
        elif tag in ARTICLE or "main" in lower and "role" in attributes.lower():
            kind = IN_ARTICLE
        elif not block:
            return parent
        classes = [w for a, v in _ATTR.findall(attributes) if a.lower() == "class" for w in v.strip("\"'").split()] if found else []
        label = " ".join([tag, *sorted(_DIGITS.sub("0", w) for w in classes)]).translate(_SAFE)
        self.labels.append(f"!{label}" if kind == NAMED else label)
        self.parents.append(parent)
        self.kinds.append(kind)
        return len(self.labels) - 1

    def text(self, node: int, raw: str, fresh: bool) -> bool:
        text = entities.unescape(raw) if "&" in raw else raw
        if fresh and text.isspace():
            return True
        if fresh:
            self.breaks.append(len(self.pieces))
        if not fresh and self.pieces and self.pieces[-1][0] == node:
            self.pieces[-1][1].append(text)
        else:
            self.pieces.append((node, [text]))
        return False

    def mostly_article(self) -> bool:
        """Articles hold more than half of the text that is not set apart."""
        size = [0, 0, 0]
        for n, parts in self.pieces:
            size[self.kinds[n]] += sum(map(len, parts))
        return size[IN_ARTICLE] > size[PLAIN]

    def skeleton(self) -> tuple[str, list[int]]:
        """The tree as text, runs of siblings of one shape taken as one; and for each element its place in it."""
        n = len(self.labels)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[self.parents[i]].append(i)
        shape, size, like = [0] * n, [1] * n, list(range(n))
        shapes: dict[tuple, int] = {}
        kept: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):  # parents come before their children
            run = -1
            for k in kids[i]:
                if run >= 0 and shape[k] == shape[run]:
                    like[k] = run
                else:
                    run = k
                    kept[i].append(k)
                    size[i] += size[k]
            shape[i] = shapes.setdefault((self.labels[i], *(shape[k] for k in kept[i])), len(shapes))
        place = [0] * n
        for i in range(n):  # an element of a run has the places of the run's first
            after = place[i] + 1
            first: dict[int, int] = {}
            for k in kids[i]:
                if like[k] == k:
                    first[k] = place[k] = after
                    after += size[k]
                else:
                    place[k] = first[like[k]]
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            if i < 0:
                out.append(")")
            else:
                out += ["(", self.labels[i]]
                todo.append(-1)
                todo += reversed(kept[i])
        return "".join(out), place


def tree(skeleton: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Labels and children of a skeleton's elements by place, and their parents."""
    labels, kids, up, stack = [], [], [], []
    for part in re.findall(r"\([^()]*|\)", skeleton):
        if part == ")":
            stack.pop()
        else:
            up.append(stack[-1] if stack else -1)
            if stack:
                kids[stack[-1]].append(len(labels))
            stack.append(len(labels))
            labels.append(part[1:])
            kids.append([])
    return labels, kids, up


def ordered_match(at: np.ndarray, bt: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """The heaviest order-keeping match of two sequences of kinds, with ``weight`` by kinds, in linear memory."""
    out, todo = [], [(0, len(at), 0, len(bt))]
    while todo:
        s, e, t, f = todo.pop()
        while s < e and t < f and at[s] == bt[t] and at[s] >= 0:  # whole like subtrees match in some best match
            out.append((s, t))
            s, t = s + 1, t + 1
        while s < e and t < f and at[e - 1] == bt[f - 1] and at[e - 1] >= 0:
            e, f = e - 1, f - 1
            out.append((e, f))
        if s == e or t == f:
            continue
        if e - s == 1:
            w = weight[at[s], bt[t:f]]
            if w.max() > 0:
                out.append((s, t + int(w.argmax())))
            continue
        mid = (s + e) // 2
        rows = lambda lo, hi, b: (weight[a, b] for a in at[lo:hi])
        up = _scores(rows(s, mid, bt[t:f]), f - t)
        down = _scores((weight[a, bt[t:f][::-1]] for a in at[mid:e][::-1]), f - t)
        cut = t + int((up + down[::-1]).argmax())
        todo += [(s, mid, t, cut), (mid, e, cut, f)]
    return out


def _scores(rows, n: int) -> np.ndarray:
    """Weight of the best order-keeping match of all rows with the first j columns, by j."""
    row = np.zeros(n + 1, np.int64)
    for w in rows:
        best = np.maximum(row[1:], row[:-1] + w)
        np.maximum.accumulate(best, out=best)
        row[1:] = best
    return row


class Matching:
    """Simple tree matching of two skeletons: the largest order-keeping match of nodes of like labels, roots first.

    Subtrees are interned by their shape, so that each pair of shapes is matched once.
    """

    def __init__(self, one: str, other: str):
        self.a, self.b = tree(one)[:2], tree(other)[:2]
        shapes: dict[tuple, int] = {}
        self.shape = []
        for labels, kids in (self.a, self.b):
            own = [0] * len(labels)
            for i in range(len(labels) - 1, -1, -1):
                own[i] = shapes.setdefault((labels[i], *(own[k] for k in kids[i])), len(shapes))
            self.shape.append(np.array(own, np.int64))
        self.size = [0] * len(shapes)
        self.parts: list[tuple] = [()] * len(shapes)
        for key, i in shapes.items():  # children are interned before their parents
            self.parts[i] = key
            self.size[i] = 1 + sum(self.size[k] for k in key[1:])
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, x: int, y: int) -> int:
        """Nodes in the best match of two shapes."""
        if x == y:
            return self.size[x]
        p, q = self.parts[x], self.parts[y]
        if p[0] != q[0]:
            return 0
        if len(p) == 1 or len(q) == 1:
            return 1
        if (x, y) not in self.known:
            at, bt, w = self.kinds(p[1:], q[1:])
            self.known[x, y] = 1 + int(_scores((w[a, bt] for a in at), len(bt))[-1])
        return self.known[x, y]

    def kinds(self, p, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two sequences of shapes as kinds, alike in both, and the weights by kinds."""
        kinds = {s: i for i, s in enumerate(dict.fromkeys((*p, *q)))}
        w = np.zeros((len(kinds), len(kinds)), np.int64)
        mine, by_label = set(p), {}
        for s in dict.fromkeys(q):
            by_label.setdefault(self.parts[s][0], []).append(s)
        for x in mine:
            for y in by_label.get(self.parts[x][0], ()):
                w[kinds[x], kinds[y]] = self.weight(x, y)
        return np.array([kinds[s] for s in p]), np.array([kinds[s] for s in q]), w

    def partners(self) -> dict[int, int]:
        if self.a[0][0] != self.b[0][0]:
            return {}
        out, todo = {}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            below, above = self.a[1][x], self.b[1][y]
            if below and above:
                at, bt, w = self.kinds([self.shape[0][k] for k in below], [self.shape[1][k] for k in above])
                todo += [(below[i], above[j]) for i, j in ordered_match(at, bt, w)]
        return out


def align(one: str, other: str) -> dict[int, int]:
    """Simple tree matching: the places of ``one`` with a partner in ``other``."""
    if one == other:
        return {i: i for i in range(one.count("("))}
    return Matching(one, other).partners()


def path_hashes(skeleton: str) -> list[int]:
    """A hash of the labels from the root, by place."""
    labels, _, up = tree(skeleton)
    out: list[int] = []
    for label, parent in zip(labels, up, strict=True):
        out.append(text_hash(f"{out[parent] if parent >= 0 else ''}({label}"))
    return out


class Aligner(dict):
    """(slot, path) by place of a skeleton, by it and its reference; forgets all at a bound.

    The slot of an element without a partner is its path, beyond any place.
    """

    def __missing__(self, key: tuple[str, str]) -> list[tuple[int, int]]:
        if len(self) >= 2000:
            self.clear()
        to = align(*key)
        out = self[key] = [(to[i] if i in to else 2**32 + p % 2**58, p) for i, p in enumerate(path_hashes(key[0]))]
        return out


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def piece_hash(parts: list[str], host: str) -> int | None:
    """Hash of a piece of text without the name of its host; None if there is nothing but space."""
    text = squeeze("".join(parts))
    return text_hash(text.replace(host, "\0") if host else text) if text else None


def skeletons(batches, names: bool):
    """Arrow batches of (page, host, html) to host, page, fingerprint, skeleton, places and hashes of the texts."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for page, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p = Page(source, names)
            skeleton, place = p.skeleton()
            found, inside, mostly = set(), [], p.mostly_article()
            for n, parts in p.pieces:
                if p.kinds[n] == NAMED:
                    found.add((4 * place[n] + NAMED, 0))
                elif (h := piece_hash(parts, host)) is not None:
                    found.add((4 * place[n] + p.kinds[n], h))
                    if p.kinds[n] == IN_ARTICLE:
                        inside.append(h)
            found = sorted(found)
            fp = text_hash(repr(inside if mostly else found))
            rows.append((host, page, fp, skeleton, mostly, [a for a, _ in found], [h for _, h in found]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], ["host", "page", "fp", "skeleton", "mostly", "slots", "hashes"])


def aligned(batches):
    """Arrow batches of (host, skeleton, slots, hashes, reference skeleton) to (host, slot, path, hash)."""
    known = Aligner()
    for batch in batches:
        hosts, rest = [], []
        for host, skeleton, own, h, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            to = known[skeleton, ref]
            cells = {(4 * to[a // 4][0] + a % 4, to[a // 4][1], x) for a, x in zip(own, h, strict=True)}
            hosts += [host] * len(cells)
            rest += cells
        slots, paths, hashes = zip(*rest, strict=True) if rest else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (slots, paths, hashes))], ["host", "slot", "path", "hash"])


def main_text(p: Page, host: str, to: list[tuple[int, int]], place: list[int], fixed: set[tuple[int, int]], template: set[int]) -> str:
    """Blocks of a page's texts that its host's wrapper does not hold."""
    out, block, starts = [], [], set(p.breaks)
    for i, (n, parts) in enumerate(p.pieces):
        if i in starts:
            out.append("".join(block))
            block = []
        slot = 4 * to[place[n]][0] + p.kinds[n] if to else -1
        if slot in template or ((slot, piece_hash(parts, host)) in fixed if fixed else False):
            continue
        block += parts
    out.append("".join(block))
    return " ".join(t for t in map(squeeze, out) if t)


def extract_batches(batches, names: bool):
    """Arrow batches of (page_id, url, html, host, reference, fixed slots, fixed hashes, template slots) to the result."""
    known = Aligner()
    for batch in batches:
        texts = []
        for source, host, ref, slots, hashes, template in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
            p = Page(source, names)
            if ref is None:
                texts.append(main_text(p, host, [], [0] * len(p.labels), set(), set()))
            else:
                skeleton, place = p.skeleton()
                texts.append(main_text(p, host, known[skeleton, ref], place, set(zip(slots or (), hashes or (), strict=True)), set(template or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str):
    """The host in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def induce(pages: DataFrame, store: Store, fixed_share: float = 0.5, article_share: float = 0.9, stock_share: float = 0.2, pool_share: float = 0.05, names: bool = True) -> DataFrame:
    """The wrappers of ``pages`` (page, host, html): host, ref (skeleton), f_slots and f_hashes (texts that are template at
    a slot), template (slots that are).

    All shares are posterior means with two pages of prior, one of them like a template (a little more where articles
    hold most of the text), so that one rule serves hosts of any size. A template text also needs a tenth of its host's pages.
    """
    rows = store.table(pages.mapInArrow(lambda it: skeletons(it, names), "host string, page bigint, fp bigint, skeleton string, mostly boolean, slots array<bigint>, hashes array<bigint>"), "skeletons")
    each = store.table(rows.groupBy("host", "fp").agg(F.min(F.struct("page", "skeleton", "mostly", "slots", "hashes")).alias("p")).select("host", "p.*"), "distinct")
    refs = store.table(each.groupBy("host").agg(F.min(F.struct("page", "skeleton"))["skeleton"].alias("ref"), F.count("*").alias("n"), F.avg(F.col("mostly").cast("int")).alias("mostly")), "references")
    near = small(refs, F.length("ref") + F.length("host") + 16)
    cells = each.select("host", "skeleton", "slots", "hashes").join(near.select("host", "ref"), "host").mapInArrow(aligned, "host string, slot bigint, path bigint, hash bigint")
    counts = store.table(cells.groupBy("host", "slot", "path", "hash").agg(F.count("*").alias("k")), "cells")
    kind = F.pmod("slot", F.lit(4))
    named = counts.filter(kind == NAMED).select("host", "slot").distinct()
    # texts inside articles: of the host's pages; one page of prior that it is none
    facts = counts.filter(kind != NAMED).join(near.select("host", "n", "mostly"), "host")
    inside = facts.filter(kind == IN_ARTICLE).filter((F.col("k") - 1) / F.col("n") > article_share)
    # texts outside: of the pages that have the slot
    outside = facts.filter(kind == PLAIN)
    slots = store.table(outside.groupBy("host", "slot", "path").agg(F.sum("k").alias("m"), F.count("*").alias("d")), "slots")
    like = 1 + 0.2 * F.col("mostly")
    share = (F.col("k") - 1 + like) / (F.least("m", "n") + 1)
    fixed = outside.join(slots.select("host", "slot", "m"), ["host", "slot"]).filter((share > fixed_share) & (F.col("k") / (F.col("n") + 1) >= 0.1))
    pairs = inside.select("host", "slot", "hash").unionAll(fixed.select("host", "slot", "hash")).groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("f"))
    few = lambda d, m: F.col(d) / (F.col(m) + 1)
    own = slots.filter(few("d", "m") <= stock_share).select("host", "slot")
    texts = outside.groupBy("path", "hash").agg(F.sum("k").alias("k"))
    pool = texts.groupBy("path").agg(F.sum("k").alias("pm"), F.count("*").alias("pd")).filter(few("pd", "pm") <= pool_share).select("path")
    known = texts.filter("k > 1").join(pool, "path").select("path", "hash").withColumn("known", F.lit(True))
    pooled = outside.join(pool, "path", "left_semi").join(known, ["path", "hash"], "left").groupBy("host", "slot").agg(F.sum(F.when(F.col("known"), F.col("k"))).alias("hit"), F.sum("k").alias("m"))
    pooled = pooled.filter(F.coalesce("hit", F.lit(0)) >= (1 - stock_share) * F.col("m")).select("host", "slot")
    template = named.unionAll(own).unionAll(pooled).groupBy("host").agg(F.collect_set("slot").alias("template"))
    return refs.join(pairs, "host", "left").join(template, "host", "left").select("host", "ref", F.col("f.slot").alias("f_slots"), F.col("f.hash").alias("f_hashes"), "template")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, salts: int = 16, wrappers: bool = True, store: Store | None = None, **shares) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    ``shares`` are the parameters of :func:`induce`. A null url or one without host is a host of its own, a null html
    is empty. Repeated rows give repeated results, ties among a host's pages go to the least page_id; an empty table
    gives an empty one; other columns are not read. Texts of any length are taken whole: a page takes memory in proportion
    to its html, and elements deeper than ``DEEPEST`` count as children of the one at that depth. Character references are
    decoded once; white space in a block becomes one space; blocks are joined by one space. Without ``wrappers`` all
    text of a page is its main text.

    The table of wrappers is broadcast if it has at most ``broadcast_bytes``; otherwise the pages of a host are dealt to
    ``salts`` parts and joined with it.
    """
    src = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    store = store or Store(pages.sparkSession)
    if wrappers:
        made = store.table(induce(src.select(F.col("page_id").cast("long").alias("page"), "host", "html"), store, **shares), "wrappers")
        room = F.length("ref") + F.length("host") + 64 + 16 * F.greatest(F.size("f_slots"), F.lit(0)) + 8 * F.greatest(F.size("template"), F.lit(0))
        side = small(made, room, broadcast_bytes)
        if side is made:
            src = src.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
            joined = src.join(made.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), ["host", "salt"], "left")
        else:
            joined = src.join(side, "host", "left")
    else:
        joined = src.selectExpr("*", "cast(null as string) ref", "cast(null as array<bigint>) f_slots", "cast(null as array<bigint>) f_hashes", "cast(null as array<bigint>) template")
    joined = joined.select("page_id", "url", "html", "host", "ref", "f_slots", "f_hashes", "template")
    kept = [f.dataType.simpleString() for f in joined.schema.fields[:2]]
    names = shares.get("names", True)
    return joined.mapInArrow(lambda it: extract_batches(it, names), f"page_id {kept[0]}, url {kept[1]}, text string, n_chars bigint")
