"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: the text between block-level tags, with its open containers. A logistic
classifier scores each block by its words, links, tags and class names; a positive score is its capacity from
the content terminal, a negative one its capacity to the boilerplate terminal. Neighbours in page order, and
neighbours among the blocks of one container, are joined by smoothness edges that weaken with their distance in
the tree, also across the rims of articles and of parts marked as around them. The minimum cut parts content from
boilerplate. Only what is certainly no text of the article (hidden parts, menus, forms, readers' comments) has a fixed
score. A form that holds the page's heading or nearly all its words is a frame of the page rather than a form.

Blocks whose own capacity outweighs all their edges keep their side in some minimum cut; they are settled
first, over and over, and only what stays open goes to max-flow. The classifier is trained on pages that
``page_layouts`` makes by rule.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend search".split())
RAW = frozenset("script style noscript template textarea title svg iframe select canvas audio video annotation annotation-xml".split())
#: Of these, those that nothing but their own end tag ends.
OPEN_ENDED = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CERTAIN = frozenset("nav menu dialog button fieldset search".split())
ASIDE = frozenset("aside footer".split())
#: Elements that a new one of the same group closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Words in a class, id or role that mark parts around the article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored promo banner banners "
    "nav navbar navigation navbox menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar topnav mainnav subnav sidenav colophon "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "share sharing social signup login signin related recommended recommendations widget widgets pagination pager skip complementary contentinfo".split()
)
#: Words that mark what readers wrote below the article.
READERS = frozenset("comment comments commentlist disqus".split())
#: Words beside which those above only say that a part has such things.
HAVING = frozenset("has have with without no layout layouts open enabled disabled free".split())
#: Words that often mark parts around the article, and as often stand in its own class names.
PERHAPS = frozenset("aside promotion promoted copyright legal discussion respond reply replies ugc notice notices notification alert overlay disclaimer follow register form search popular trending teaser meta toc".split())
#: Words in a class or id that mark the article.
WITHIN = frozenset("article content post story entry main body text".split())
FEATURES = ("bias", "article", "outside", "around", "perhaps", "within", "words", "links", "cited", "heading", "short")
#: A form with this part of the words is the frame of the page.
FRAME = 0.8
#: Score of what is certainly no text of the article.
NEVER = -50.0
SMOOTH = 2.0

# An attribute's value may hold < and > in quotes. A quote that never ends is part of a name: there is no other of its kind after it.
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|</?[a-zA-Z][^<>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Node:
    """An open container: what it says of itself, and of all that is in it (marks add up from the root)."""

    __slots__ = ("name", "parent", "depth", "own", "marks", "article", "words", "headed", "readers", "main")

    def __init__(self, name, parent, own=frozenset()):
        self.name, self.parent, self.own = name, parent, own
        self.depth = parent.depth + 1 if parent else 0
        self.marks, self.article, self.words, self.headed, self.readers = own, False, 0, False, False
        self.main = name in ("article", "main") or "main" in own


def _marks(name: str, attributes: str, in_article: bool) -> frozenset:
    out = {"never"} if name in CERTAIN else {"around"} if name in ASIDE else {"form"} if name == "form" else set()
    if attributes and name not in ("html", "body", "main"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.add("never")
            elif key == "role" and value in ("main", "article"):
                out |= {"main", "within"}
            elif key in ("class", "id", "role", "itemprop"):
                for one in value.split():
                    words = {x.lower() for x in _PART.findall(one)}
                    having = not words.isdisjoint(HAVING)
                    if not having and not words.isdisjoint(READERS):
                        out |= {"around", "readers"}
                    elif not having and (not words.isdisjoint(AROUND) or "site" in words and not words.isdisjoint(PERHAPS)):
                        out.add("around")  # a notice of the site isn't one of the article
                    elif not words.isdisjoint(WITHIN):
                        out.add("within")
                    if not words.isdisjoint(PERHAPS):
                        out.add("perhaps")
    if "around" in out and "main" not in out:  # a comment-body is a comment
        out.discard("within")
    # The header of a page goes, that of an entry stays.
    if name == "header" and not in_article and "within" not in out:
        out.add("around")
    return frozenset(out)


def blocks(page: str) -> list[tuple[str, _Node, int, bool]]:
    """(text, container, characters inside links, heading) in page order, without empty ones. Work is linear in the page."""
    out, text, linked = [], [], 0
    node, in_link = _Node("", None), False
    nodes, opened, unclosed = [node], {}, set()
    articles = 0  # how many are open
    at, end = 0, len(page)

    def flush(heading: bool) -> None:
        joined = " ".join(_html.unescape("".join(text)).split())
        if joined:
            out.append((joined, node, min(linked, len(joined)), heading))

    def up(n):
        nonlocal articles
        opened[n.name] -= 1
        articles -= n.main
        return n.parent

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            text.append(token)
            if in_link:
                linked += len(token)
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCKS or name in CERTAIN
        if m[1]:
            if name == "a":
                in_link = False
            if not block:
                continue
        elif name in RAW:
            # Raw content ends at its own end tag, or with the page; one without content has none.
            if m[3].endswith("/") and name not in OPEN_ENDED:
                continue
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
                at = end if name in OPEN_ENDED else at
            continue
        elif name == "a":
            in_link = True
            continue
        elif name in VOID and name != "hr":
            if name == "br":
                text.append(" ")
            continue
        elif not block:
            continue
        flush(node.name[:1] == "h" and node.name[1:].isdigit())
        text, linked = [], 0
        if m[1]:
            if opened.get(name):  # each container is closed once
                while node.name != name:
                    node = up(node)
                node, in_link = up(node), False
        elif name != "hr":
            in_link = False
            if node.name == "p":  # a block ends an open paragraph
                node = up(node)
            for _ in range(3):
                if node.name in CLOSES.get(name, ()):
                    node = up(node)
            node = _Node(name, node, _marks(name, m[3], articles > 0))
            nodes.append(node)
            opened[name] = opened.get(name, 0) + 1
            articles += node.main
    flush(False)
    _settle_marks(nodes, out)
    return out


def _settle_marks(nodes: list[_Node], found: list) -> None:
    """Hand marks down the tree.

    What holds the page's main article isn't around it: an article or main with at least half of the words that stand in
    no marked part inside it. What holds the page's heading isn't written by readers, nor is it a form.
    """
    for n in nodes:
        n.words, n.headed = 0, (n.name == "h1" or n.main) and "readers" not in n.own
    for text, node, _, _ in found:
        node.words += text.count(" ") + 1
    bad = frozenset(("around", "never"))
    inside, forms = {}, []
    for n in nodes:  # parents come before children
        n.readers = "readers" in n.own or bool(n.parent and n.parent.readers)
    # Words of a container that no part inside it marks as around, from the leaves up; articles gather them past their own marks.
    for n in reversed(nodes):
        total_here = n.words
        if n.main and not n.readers:
            inside[id(n)] = (total_here, n)
        if n.name == "form":
            forms.append(n)
        if n.parent is not None:
            if n.headed and not n.readers:
                n.parent.headed = True
            if n.own.isdisjoint(bad) or n.main and "readers" not in n.own:
                n.parent.words += total_here
    total = nodes[0].words
    clear = {id(n) for n in forms if n.headed or n.words >= FRAME * total}
    # An article's own marks are ignored only where no article is without.
    plain = [x for x in inside.values() if x[1].own.isdisjoint(bad)]
    for n, node in plain or inside.values():
        whole = max(total, n)
        while node is not None and 2 * n >= whole and id(node) not in clear:
            clear.add(id(node))
            node = node.parent
    for n in nodes:
        own = n.own - bad - {"readers", "form"} if id(n) in clear else n.own
        if not own.isdisjoint(("readers", "form")):
            own = own | {"never"}
        outside = n.parent is not None and not n.parent.marks.isdisjoint(bad)
        if outside:  # a part of what is around the article doesn't mark the article
            own = own - {"within"}
        n.marks = own if n.parent is None else own | n.parent.marks - ({"within"} if not own.isdisjoint(bad) else set())
        n.article = n.main and n.marks.isdisjoint(bad) or bool(n.parent and n.parent.article)


def features(found: list) -> np.ndarray:
    """A row for each block, by FEATURES."""
    # The part of the words that stand in an article or main bounds what that counts: all from one half on.
    mass = [0, 0]
    for text, node, _, _ in found:
        if node.marks.isdisjoint(("around", "never")):
            mass[node.article] += text.count(" ") + 1
    sure = min(1.0, 2 * mass[1] / max(1, sum(mass)))
    rows = []
    for text, node, linked, heading in found:
        n, m = text.count(" ") + 1, node.marks
        inside = node.article
        links = linked / len(text)
        cited = links * (not m.isdisjoint(("within",)) or inside) * m.isdisjoint(("around", "perhaps"))
        rows.append((1.0, sure * inside, sure * (not inside), "around" in m, "perhaps" in m, "within" in m, min(n, 40) / 10, links, cited, heading, n < 5 and not heading))
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


def trained(pages: list[tuple[str, set[str]]], rounds: int = 400, keep: float = 1e-3) -> np.ndarray:
    """Weights of the logistic classifier, by Newton steps on blocks of pages given with the texts of their content blocks."""
    xs, ys = [], []
    for page, content in pages:
        found = blocks(page)
        free = [k for k, b in enumerate(found) if "never" not in b[1].marks]
        xs.append(features(found)[free])
        ys += [float(found[k][0] in content) for k in free]
    x, y = np.concatenate(xs), np.array(ys)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep * len(y) * np.eye(len(w)), x.T @ (y - p) - keep * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    from gradelake.llm.page_layouts import training_pages

    return trained(training_pages())


def scores(found: list, w: np.ndarray | None = None) -> list[float]:
    """The classifier's score of each block: above 0 for content."""
    out = features(found) @ (weights() if w is None else w)
    return [NEVER if "never" in b[1].marks else float(s) for b, s in zip(found, out)]


def edges(found: list, smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and neighbours among the blocks of one parent."""
    out, last = [], {}
    for k in range(1, len(found)):
        a, b, d = found[k - 1][1], found[k][1], 0
        while a is not b and d < 8:
            a, b = (a.parent, b) if a.depth > b.depth else (a, b.parent) if b.depth > a.depth else (a.parent, b.parent)
            d += 1
        out.append((k - 1, k, smooth * 0.5**d))
    for k, b in enumerate(found):
        parent = id(b[1].parent)
        j = last.get(parent)
        if j is not None and j < k - 1:
            out.append((j, k, smooth / 4))
        last[parent] = k
    return out


def min_cut(score: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for each block on the content side of a minimum cut."""
    n = len(score)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    score, label = list(score), [None] * n
    queue = deque(range(n))
    while queue:  # settle what no edge can turn
        k = queue.popleft()
        if label[k] is None and abs(score[k]) >= sum(around[k].values()):
            label[k] = score[k] > 0
            for j, w in around[k].items():
                del around[j][k]
                score[j] += w if label[k] else -w
                queue.append(j)
            around[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        side = _max_flow(score, around, rest)
        for k in rest:
            label[k] = k in side
    return label


def _max_flow(score: list[float], around: list[dict[int, float]], rest: list[int]) -> set[int]:
    """The source side of a minimum cut: blocking flows along shortest paths, a level graph at a time."""
    left = {k: dict(around[k]) for k in rest}
    source = {k: score[k] for k in rest if score[k] > 0}
    sink = {k: -score[k] for k in rest if score[k] < 0}
    tiny = 1e-12
    while True:
        level = {k: 0 for k, c in source.items() if c > tiny}
        queue, reached = deque(level), False
        while queue:
            k = queue.popleft()
            if sink.get(k, 0.0) > tiny:
                reached = True
                continue
            for j, c in left[k].items():
                if c > tiny and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        ways = {k: [j for j in left[k] if level.get(j) == level[k] + 1] for k in level}
        for start in [k for k in level if level[k] == 0]:
            path = [start]
            while path and source[start] > tiny:
                k = path[-1]
                if sink.get(k, 0.0) > tiny:
                    push = min(sink[k], source[start], *(left[a][b] for a, b in zip(path, path[1:])))
                    sink[k] -= push
                    source[start] -= push
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= push
                        left[b][a] = left[b].get(a, 0.0) + push
                    # Back to before the first edge that is full.
                    path = path[: next((i + 1 for i, (a, b) in enumerate(zip(path, path[1:])) if left[a][b] <= tiny), len(path))]
                    continue
                while ways[k] and left[k][ways[k][-1]] <= tiny:
                    ways[k].pop()
                if ways[k]:
                    path.append(ways[k][-1])
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def main_text(page: str | None, w: np.ndarray | None = None) -> str:
    """The content blocks of a page in page order, one to a line; empty for a null or empty page."""
    found = blocks(page or "")
    if not found:
        return ""
    label = min_cut(scores(found, w), edges(found))
    return "\n".join(b[0] for b, keep in zip(found, label) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; text is empty for null, empty or textless pages.

    Repeated rows and null ids are kept, other columns are ignored; an empty table gives no rows. A page may be
    of any length: reading is linear in it, and max-flow runs over the blocks that stay open only.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    w = weights()

    def each(batches):
        for batch in batches:
            text = [main_text(x.as_py(), w) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = rows.schema
    return rows.mapInArrow(each, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars bigint")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
