"""HTML extraction by wrapper induction.

A page's tree is reduced to a skeleton: element labels (tag and first class), with runs of alike siblings as one node. The
page with the smallest page_id is its host's reference; all other trees of the host are aligned with it by simple tree matching (the
largest order-preserving match of nodes whose labels agree). For each reference node, all different pages together tell how
many have it, and in how many its own text is the reference's. Varying nodes are slots; a node whose text is the reference's in ``CONSTANT`` of
at least ``LEAST_PAGES`` different pages is template, wherever it is. A run is one node, so a paragraph among varying ones stays.
The content is the deepest node that holds all of the varying text, not counting slots of
elements that never hold an article (menus, forms, adverts and so on); an article or main element settles it if most of the varying text is there. From each page
the node aligned with the content is read: its blocks, without such elements and without the texts that are template. Pages whose tree lacks the
node, or hosts without varying text, use the page's own article or main element, or else its body. Copies of a page count once, so a
host that shows one article many times has no template from that.

Null or empty html and pages without text give an empty string. A null url is a host of its own. Every row gives one row, repeated ones too. An
empty table gives an empty result. Statistics cover all pages and are pre-aggregated; wrappers have one row for each host and are broadcast
only if they are measured to be small, else they meet the pages in a join that adaptive execution splits.
"""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, saved

SMALL_BYTES = 16 << 20
CONSTANT, LEAST_PAGES = 0.9, 5
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "li", "dd", "dt"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and names that are never part of an article.
NOISE_TAGS = RAW | frozenset("nav header footer aside form button select input label menu dialog head canvas object embed audio video".split())
NOISE_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|side|footer|masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommended|toolbar|pagination|pager|skip|hidden|login|signup|search)(?:$|[-_\s\d])", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())


class Node:
    __slots__ = ("children", "label", "noise", "tag")

    def __init__(self, tag: str, label: str, noise: bool):
        self.tag, self.label, self.noise, self.children = tag, label, noise, []


#: Elements nested deeper go on at this depth, as browsers have it too; their text stays, in its order.
DEEP = 200


def parse(html: str) -> Node:
    """A forgiving tree: children are nodes and strings; unclosed elements end with their parents."""
    root = Node("#", "#", False)
    stack, at, n, lower, flat = [root], 0, len(html), None, {}
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if flat.get(tag):
                flat[tag] -= 1
                stack[-1].children.append(Node(tag, tag, False))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    # an inline end tag doesn't close the blocks around it
                    if tag in BLOCKS or not any(x.tag in BLOCKS for x in stack[k + 1 :]):
                        del stack[k:]
                    break
            continue
        if tag in ENDS_P and any(x.tag == "p" for x in stack):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        elif tag in CLOSES:
            mine, scope = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in mine:
                    del stack[k:]
                    break
        names = role = ""
        noise = tag in NOISE_TAGS
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    noise = True
            noise = noise or role in NOISE_ROLES or tag not in ("article", "main", "body", "html") and bool(NOISE_NAMES.search(names))
        first = names.split()
        node = Node(tag, tag + ("." + first[0] if first else ""), noise)
        stack[-1].children.append(node)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + tag, at)
            at = n if end < 0 else end
            stack.append(node)
            if end < 0:
                break
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            if len(stack) < DEEP or noise:
                stack.append(node)
            else:
                flat[tag] = flat.get(tag, 0) + 1
    return root


def text_of(node: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks in page order, joined by line feeds, without elements that are noise and without the own texts of those whose id() is in ``template``."""
    blocks, now = [], []

    def end() -> None:
        t = " ".join(entities.unescape("".join(now)).split())
        if t:
            blocks.append(t)
        now.clear()

    def walk(x: Node, mute: bool) -> None:
        for c in x.children:
            if isinstance(c, str):
                if not mute:
                    now.append(c)
            elif c.tag == "br":
                now.append(" ")
            elif c.noise:
                if c.tag in BLOCKS:
                    end()
            elif c.tag in BLOCKS:
                end()
                walk(c, id(c) in template)
                end()
            else:
                walk(c, mute)

    walk(node, id(node) in template)
    end()
    return "\n".join(blocks)


def skeleton(node: Node) -> tuple[list, list[list[Node]]]:
    """(nested [label, noise, children], nodes in preorder, each with all elements of its run); alike neighbours without child elements of their own are one."""
    nodes: list[list[Node]] = []

    def walk(x: Node):
        nodes.append([x])
        out, last = [], None
        for c in x.children:
            if isinstance(c, str) or c.tag not in BLOCKS and c.tag not in NOISE_TAGS:
                continue
            leaf = not any(not isinstance(y, str) and y.tag in BLOCKS for y in c.children)
            key = (c.label, c.noise) if leaf else None
            if key and key == last:
                alike.append(c)
                continue
            last, at = key, len(nodes)
            out.append(walk(c))
            alike = nodes[at]
        return [x.label, x.noise, out]

    return walk(node), nodes


def match_trees(a: list, b: list) -> dict[int, int]:
    """Simple tree matching: preorder numbers of ``a`` to those of ``b``, of a largest match with equal labels."""
    sizes: dict[int, int] = {}

    def size(t) -> int:
        k = id(t)
        if k not in sizes:
            sizes[k] = 1 + sum(map(size, t[2]))
        return sizes[k]

    memo: dict = {}

    def score(x, y) -> int:
        if x[0] != y[0]:
            return 0
        key = (id(x), id(y))
        if key not in memo:
            memo[key] = 1 + table(x, y)[len(x[2])][len(y[2])]
        return memo[key]

    def table(x, y):
        t = [[0] * (len(y[2]) + 1) for _ in range(len(x[2]) + 1)]
        for i, c in enumerate(x[2], 1):
            for j, d in enumerate(y[2], 1):
                t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + score(c, d))
        return t

    out: dict[int, int] = {}

    def trace(x, y, nx: int, ny: int) -> None:
        out[nx] = ny
        t, i, j = table(x, y), len(x[2]), len(y[2])
        px, py = [nx + 1], [ny + 1]
        for c in x[2]:
            px.append(px[-1] + size(c))
        for d in y[2]:
            py.append(py[-1] + size(d))
        while i and j:
            s = score(x[2][i - 1], y[2][j - 1])
            if s and t[i][j] == t[i - 1][j - 1] + s:
                i, j = i - 1, j - 1
                trace(x[2][i], y[2][j], px[i], py[j])
            elif t[i][j] == t[i - 1][j]:
                i -= 1
            else:
                j -= 1

    if a[0] == b[0]:
        trace(a, b, 0, 0)
    return out


_matches: dict[tuple[str, str], dict[int, int]] = {}


def matched(a: str, b: str) -> dict[int, int]:
    """Match of two skeletons in JSON; pages of one template share few skeletons."""
    if (a, b) not in _matches:
        if len(_matches) > 20_000:
            _matches.clear()
        _matches[a, b] = match_trees(json.loads(a), json.loads(b))
    return _matches[a, b]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, whatever characters it has; empty if there is none. Wrappers and pages meet by this alone."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1), F.lit("")))


def _own_text(node: Node) -> str:
    """Text that isn't in a child that the skeleton has."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in BLOCKS and c.tag not in NOISE_TAGS:
            out.append(_own_text(c))
    return "".join(out)


def _run_text(run: list[Node]) -> str:
    """Own text of a node's elements, white space made alike."""
    return " ".join(" ".join(map(_own_text, run)).split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def page_skeletons(pages: DataFrame) -> DataFrame:
    """(page_id, host, skel, hashes and lengths of the nodes' own texts, digest of the page's skeleton and texts)."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for i, host, h in zip(pdf["page_id"], pdf["host"], pdf["html"], strict=True):
                tree, nodes = skeleton(parse(h or ""))
                skel, own = json.dumps(tree, separators=(",", ":")), [_run_text(run) for run in nodes]
                rows.append((i, host, skel, [_hash(t) for t in own], [len(t) for t in own], _hash(json.dumps([skel, own]))))
            yield pd.DataFrame(rows, columns=["page_id", "host", "skel", "hashes", "sizes", "digest"])

    return pages.select("page_id", host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "page_id long, host string, skel string, hashes array<long>, sizes array<int>, digest long")


def wrappers(pages: DataFrame) -> DataFrame:
    """One row for each host: host, skel (the reference's), content (its node, or -1), template (nodes) and template_hashes (of their texts)."""
    one = F.min(F.struct("page_id", "skel", "hashes", "sizes")).alias("one")
    skels = saved(page_skeletons(pages).groupBy("host", "digest").agg(one).select("host", "one.*"))
    first = skels.groupBy("host").agg(F.min("page_id").alias("page_id"))
    refs = skels.join(first, ["host", "page_id"]).dropDuplicates(["host"]).select("host", F.col("skel").alias("ref"), F.col("hashes").alias("ref_hashes"))

    def align(pdfs):
        for pdf in pdfs:
            sums: dict = {}
            for h, ref, rh, skel, hs, ns in zip(pdf["host"], pdf["ref"], pdf["ref_hashes"], pdf["skel"], pdf["hashes"], pdf["sizes"], strict=True):
                for a, b in matched(ref, skel).items():
                    s = sums.setdefault((h, a), [0, 0, 0])
                    s[0] += 1
                    s[1] += int(rh[a] == hs[b])
                    s[2] += int(ns[b])
            yield pd.DataFrame([(h, a, *s) for (h, a), s in sums.items()], columns=["host", "node", "n", "same", "size"])

    stats = skels.join(refs, "host").select("host", "ref", "ref_hashes", "skel", "hashes", "sizes").mapInPandas(align, "host string, node int, n long, same long, size long")
    per_host = stats.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("size").alias("size"))
    listed = per_host.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "size")).alias("stats"))  # as long as a reference tree

    def choose(pdfs):
        for pdf in pdfs:
            rows = []
            for h, ref, rh, st in zip(pdf["host"], pdf["ref"], pdf["ref_hashes"], pdf["stats"], strict=True):
                fixed = [s["node"] for s in st if s["size"] and s["n"] >= LEAST_PAGES and s["same"] >= CONSTANT * s["n"]]
                rows.append((h, ref, content_node(json.loads(ref), {s["node"]: (s["n"], s["same"], s["size"]) for s in st}), fixed, [rh[a] for a in fixed]))
            yield pd.DataFrame(rows, columns=["host", "skel", "content", "template", "template_hashes"])

    kind = "host string, skel string, content int, template array<int>, template_hashes array<long>"
    return saved(refs.join(listed, "host").select("host", "ref", "ref_hashes", "stats").mapInPandas(choose, kind))


def content_node(ref: list, stats: dict[int, tuple[int, int, int]]) -> int:
    """The deepest node of the reference with all of the varying text; an article or main element if one has most of it."""
    nodes: list[tuple[list, int, int, bool]] = []  # tree, parent, end, under noise

    def walk(t, parent, noise):
        k = len(nodes)
        nodes.append((t, parent, 0, noise or t[1]))
        for c in t[2]:
            walk(c, k, noise or t[1])
        nodes[k] = (t, parent, len(nodes), noise or t[1])

    walk(ref, -1, False)
    varying = [0.0] * len(nodes)
    for k, (n, same, size) in stats.items():
        if k < len(nodes) and not nodes[k][3] and (same < CONSTANT * n or n < 3):
            varying[k] = size
    mass = [sum(varying[k:end]) for k, (_, _, end, _) in enumerate(nodes)]
    if not mass[0]:
        return -1
    for tags in (("article",), ("main",)):
        best = [k for k, x in enumerate(nodes) if x[0][0].split(".")[0] in tags and not x[3] and 2 * mass[k] >= mass[0]]
        if best:
            return max(best, key=lambda k: (mass[k], -k))
    k = 0
    while True:
        kids = [c for c, x in enumerate(nodes) if x[1] == k and x[0][2] and mass[c] == mass[k]]
        if not kids:
            return k
        k = kids[0]


def _fallback(root: Node) -> Node:
    found: dict[str, Node] = {}

    def walk(x: Node) -> None:
        for c in x.children:
            if not isinstance(c, str) and not c.noise:
                if c.tag in ("article", "main", "body") and c.tag not in found:
                    found[c.tag] = c
                walk(c)

    walk(root)
    return found.get("article") or found.get("main") or found.get("body") or root


def main_text(html: str | None, ref: str | None, content: int, fixed: list[tuple[int, int]]) -> str:
    """The page's text by its host's wrapper; ``fixed`` has the template's nodes and text hashes."""
    root = parse(html or "")
    if ref is not None and content >= 0:
        tree, nodes = skeleton(root)
        to = matched(ref, json.dumps(tree, separators=(",", ":")))
        if content in to:
            runs = [(nodes[to[a]], t) for a, t in fixed if a in to]
            template = {id(x) for run, t in runs if _hash(_run_text(run)) == t for x in run}
            text = "\n".join(t for x in nodes[to[content]] if (t := text_of(x, template)))
            if text:
                return text
    return text_of(_fallback(root))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    plain = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rules = wrappers(plain.filter("page_id is not null"))
    host = host_of(F.col("url"))
    small = (rules.agg(F.sum(F.length("skel") + F.length("host") + 12 * F.size("template") + 64)).first()[0] or 0) <= SMALL_BYTES
    keyed = plain.join(F.broadcast(rules) if small else rules, host == F.col("host"), "left").select("page_id", "url", "html", "skel", F.coalesce("content", F.lit(-1)).alias("content"), F.coalesce("template", F.array().cast("array<int>")).alias("template"), F.coalesce("template_hashes", F.array().cast("array<long>")).alias("template_hashes"))

    def run(pdfs):
        for pdf in pdfs:
            texts = [main_text(h, r, c, list(zip(a, t, strict=True))) for h, r, c, a, t in zip(pdf["html"], pdf["skel"], pdf["content"], pdf["template"], pdf["template_hashes"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return keyed.mapInPandas(run, "page_id long, url string, text string, n_chars long")
