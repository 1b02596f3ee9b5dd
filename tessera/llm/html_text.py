"""Operator 8: the main text of web pages by composite text density."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import tuned

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, and those whose content is not markup.
UNSEEN = frozenset("script style noscript template textarea title head iframe object svg canvas audio video select option button datalist annotation annotation-xml map".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
#: Elements that are never part of an article.
APART = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Start tags that end an open element, up to the nearest of the limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Words that as a class, id or role name what is no part of an article, and words that may stand beside one in such
#: a name (site-footer, ad-slot-2). A name with any other word, as category-social or ad-free, tells nothing.
AWAY = frozenset(
    "nav navbar navigation menu menubar sidebar side footer masthead banner ad ads advert advertisement adverts adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay breadcrumb breadcrumbs share sharing social related recommended comment comments replies disqus respond newsletter subscribe signup login pagination pager toolbar widget search complementary contentinfo alert skip toc".split()
)
BESIDE = frozenset("main site page global top bottom left right primary secondary area bar block box button buttons container form icons inner item items link links list posts section slot unit wrap wrapper thread".split())
#: A paragraph or heading inside an article is taken out by its name only if that says advert or consent; by another, only if links are most of it.
FIRM = frozenset("ad ads advert advertisement adverts adsense sponsor sponsored cookie cookies consent gdpr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)


class Node:
    """An element: its tag, children (elements and texts in order), and whether it belongs to what is apart or may do so."""

    __slots__ = ("tag", "parent", "children", "apart", "doubtful", "by_links", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, apart: bool):
        self.tag, self.parent, self.apart, self.children = tag, parent, apart, []
        self.doubtful = self.by_links = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _apart(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is hidden or by its kind no part of an article."""
    if (tag in APART and tag != "form") or tag in UNSEEN or (tag == "header" and not in_article):
        return True
    return bool(attributes) and tag not in ("html", "body", "main") and bool(_HIDDEN.search(attributes))


def _away(name: str) -> bool:
    """Whether a class, id or role names what is no part of an article."""
    words = [w for w in re.split(r"[\s_-]+", name.lower()) if w]
    return any(w in AWAY for w in words) and all(w in AWAY or w in BESIDE or w.isdigit() for w in words)


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether an element is a form or has such a name; what it holds decides then. Articles never are."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    return any(map(_away, _names(attributes)))


def _names(attributes: str) -> list[str]:
    return [n for m in _NAMED.findall(attributes) for n in html.unescape(m.strip("\"'")).split()]


def _firm(attributes: str) -> bool:
    """Whether a name says advert or consent."""
    return any(w in FIRM for n in _names(attributes) if _away(n) for w in re.split(r"[\s_-]+", n.lower()))


class _Path:
    """The open elements from the root down, and for each tag, and for blocks, at what depths they stand."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], defaultdict(list), []

    def open(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Close all elements from this depth on; each is closed once, so a page takes time in proportion to its length."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def deepest(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are borne as browsers bear the common cases."""
    root = Node("html", None, False)
    path, token, at, n = _Path(root), _TOKEN, 0, len(page)
    while at < n:
        now = path.nodes[-1]
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            now.children.append(page[at:start])
        if start == n:
            break
        m = token.match(page, start)
        if not m and token is _TOKEN and _LOOSE.match(page, start):  # a quote that is never closed: quotes mean nothing from here on
            token = _LOOSE
            m = token.match(page, start)
        if not m:  # a plain `<`
            now.children.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in ("html", "body"):
                if tag == "body" and not path.at["body"]:
                    path.close(1)
                    root.children.append(child := Node("body", root, False))
                    path.open(child)
                continue
            if tag in CLOSES:
                ends, limits = CLOSES[tag]
                if (end := path.deepest(ends)) > path.deepest(limits):
                    path.close(end)
            elif tag in BLOCKS and path.blocks and path.nodes[path.blocks[-1]].tag == "p":
                path.close(path.blocks[-1])
            now = path.nodes[-1]
            child = Node(tag, now, now.apart or _apart(tag, m[2], bool(path.at["article"])))
            child.doubtful = not child.apart and _doubtful(tag, m[2])
            child.by_links = child.doubtful and tag in PARAGRAPHS and bool(path.at["article"] or path.at["main"]) and not _firm(m[2])
            now.children.append(child)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not (m[2].endswith("/") and tag not in BLOCKS and tag != "a"):
                path.open(child)
        elif m[3]:
            tag = m[3].lower()
            # an end tag of an inline element doesn't reach out of its block
            if tag not in ("body", "html") and path.at[tag] and (tag in BLOCKS or not path.blocks or path.at[tag][-1] > path.blocks[-1]):
                path.close(path.at[tag][-1])
    _set_apart(root)
    return root


def _set_apart(root: Node) -> None:
    """Take forms and named elements apart, unless they hold an article element or most of the text outside links.

    Most is over half, and over nine tenths where an article or main element stands elsewhere: an advert may be
    longer than a short article.
    """
    nodes = _below(root)
    if not any(n.doubtful for n in nodes):
        return
    linked: set[int] = set()
    for n in nodes:  # parents first
        if n.tag == "a" or id(n.parent) in linked:
            linked.add(id(n))
    plain = {id(n): sum(len(c.strip()) for c in n.children if isinstance(c, str)) if id(n) not in linked else 0 for n in nodes}
    whole = {id(n): sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in nodes}
    articles = {id(n): int(n.tag in ("article", "main")) for n in nodes}
    for node in reversed(nodes):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            whole[id(node.parent)] += whole[id(node)]
            articles[id(node.parent)] += articles[id(node)]
    for node in nodes:
        up = node.parent
        rest = plain[id(root)] - plain[id(node)]
        named = node.doubtful and not (node.by_links and 2 * plain[id(node)] > whole[id(node)])
        node.apart = (up is not None and up.apart) or (named and not articles[id(node)] and plain[id(node)] <= (9 if articles[id(root)] else 1) * rest)


def _below(root: Node) -> list[Node]:
    """The elements that are not apart, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.apart]
    return out


def measure(root: Node) -> list[Node]:
    """Set the composite text density of each element, and as its total the sum over its children; elements in page order.

    Characters per tag, adjusted by the logarithm of characters per link character and tags per link tag, whose
    base grows with the share of link characters in the element and in the body.
    """
    nodes = _below(root)
    for node in reversed(nodes):
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body_share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = log(c / max(c - lc, 1) * lc + body_share * c + e)
            odds = c / max(lc, 1) * t / max(lt, 1)
            # a base of 1 has no logarithm: without links anywhere all elements share the base of e
            node.density = c / t * (log(odds) / log(base) if base > 1 + 1e-9 else log(odds) if lc or lt else 1 + log(odds)) if odds > 0 else 0.0
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.apart)
    return nodes


def select(root: Node) -> list[Node]:
    """The elements that hold the main text, in page order.

    The element with the greatest sum of densities is the first choice; the least density on its path to the
    body is the threshold. Every element at or over the threshold that is not chosen yet contributes the subtree
    with the greatest sum below it. What is chosen inside an article element, or inside a main element without
    articles, widens to that element if it is at or over the threshold too; what has most of its text outside links
    in such elements is not chosen whole.
    """
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return [root]
    threshold, up = best.density, best
    while up is not None:
        if up.tag != "html":
            threshold = min(threshold, up.density)
        up = up.parent
    peak = {id(n): n for n in nodes}
    holds: set[int] = set()
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            if peak[id(node)].total >= peak[id(up)].total and peak[id(node)].total > up.total:
                peak[id(up)] = peak[id(node)]
            if node.tag == "article" or id(node) in holds:
                holds.add(id(up))
    home: dict[int, Node | None] = {}
    for node in nodes:  # parents first
        found = home.get(id(node.parent))
        home[id(node)] = node if found is None and (node.tag == "article" or (node.tag == "main" and id(node) not in holds)) else found
    marked = {id(n): n.chars - n.link_chars if home[id(n)] is n else 0 for n in nodes}
    for node in reversed(nodes):
        if home[id(node)] is None and (outer := [c for c in node.children if not isinstance(c, str) and not c.apart]):
            marked[id(node)] = sum(marked[id(c)] for c in outer)
    picked: set[int] = set()
    inside: set[int] = set()
    for node in nodes:
        if id(node.parent) in inside:
            inside.add(id(node))
        elif node is not root and node.chars and node.density >= threshold:
            chosen = peak[id(node)]
            if (around := home[id(chosen)]) is not None:
                if around.density >= threshold:  # so it is for the element that holds the first choice
                    picked.add(id(around))
            elif 2 * marked[id(chosen)] <= chosen.chars - chosen.link_chars:
                picked.add(id(chosen))
        if id(node) in picked:
            inside.add(id(node))
    return [n for n in nodes if id(n) in picked and id(n.parent) not in inside] or [best]


def blocks(node: Node) -> list[str]:
    """The text of each block of an element; elements that are apart are left out.

    Each text node has its character references decoded by itself. White space, as one space, is what Unicode and
    Python's split() count as such: no-break space and the separators \\x1c to \\x1f too.
    """
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [(node, False)]
    while todo:
        item, ended = todo.pop()
        if isinstance(item, str):
            run.append(html.unescape(item))
        elif ended:
            close()
        elif item.tag in ("br", "td", "th"):
            run.append(" ")
            todo += [(c, False) for c in reversed(item.children)]
        elif not item.apart or item is node:
            if item.tag in BLOCKS:
                close()
                todo.append((item, True))
            todo += [(c, False) for c in reversed(item.children)]
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by an empty line; empty for a null or empty page."""
    if not page:
        return ""
    return "\n\n".join(b for node in select(parse(page)) for b in blocks(node))


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; one row for each row of pages.

    Elements that by name, class, id or role are menus, headers of the page, footers, sidebars, notices, adverts,
    forms or comments are taken out first, but for no class, id, role or form an article element or most of the
    page's text outside links; densities decide among the rest. Nothing is capped; a page is
    handled by itself, so hot hosts don't matter and nothing is shuffled. Null and empty pages have an empty text,
    repeated pages repeated rows, and an empty table gives an empty one; other columns are not read.
    """
    tuned(pages.sparkSession)
    kept = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    schema = kept.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(extracted, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
