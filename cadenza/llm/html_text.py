"""Main text of web pages by composite text density.

Each page becomes a tree (unclosed paragraphs, list items and cells are closed
as browsers do). For every node: C characters, T tags, LC characters in links,
LT links, all over its subtree; its density is C / T, scaled by a logarithm that
falls as links take over (LC and LT against C and T, the base growing with the
page's own share of link text). A node's density sum is its children's total.
The node of the greatest sum is the seed; the least density on its path from the
body is the threshold. The seed's article or main element is the main text if
it has one; else every branch off the path whose density reaches the threshold
adds its own greatest-sum subtree. Menus, page headers, footers, side bars,
notices, adverts, forms, comments and hidden parts are recognised by element,
role or class words and count for nothing, unless they hold the article or main
element or half of the page's text outside links: those are plain blocks, and
their parts are judged each by itself. If nothing is left, all words are ignored.

Blocks are the text between block-level tags, character references decoded,
white space made one space; <br> is white space. A null, blank or tagless page
has whatever text it has, "" if none. Rows are judged each by its own html.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, with_id

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_INSIDE = re.compile(r"=\s*+([\"'])|>")
_COMMENT_END = re.compile("--!?>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_RAW_END = {name: re.compile(f"</{name}\\s*+>", re.I) for name in RAW}
#: Elements that a start tag of this name closes, and where the search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
OUT_TAG = frozenset("nav footer aside form dialog menu search button select fieldset svg math canvas object audio video head".split()) | RAW
#: What is no text of the page wherever it stands.
NEVER = frozenset("button select svg math canvas object audio video head".split()) | RAW
#: Least share of the page's text outside links that makes a part a plain block,
#: and least share in another article or main element that prevents it.
WRAPS, ELSEWHERE = 0.5, 0.1
OUT_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUT_WORD = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement adsense "
    "banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended recommendations comment comments disqus respond reply replies login search "
    "widget toolbar pagination pager masthead copyright skip".split()
)
NEGATION = frozenset("no with has without".split())
CORE = frozenset("html body main".split())
#: For an article element only these count: others often name what it has.
OUT_ARTICLE = frozenset("comment comments reply related recommended ad ads advert promo sponsored".split())


def _is_out(tag: str, attrs: str, inside: bool) -> bool:
    if tag in OUT_TAG:
        return True
    if tag == "header" and not inside:
        return True
    if tag in CORE or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        if m[5]:
            return True
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in OUT_ROLE:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = _WORD.findall(word)
                out = OUT_ARTICLE if tag == "article" else OUT_WORD
                if parts and not NEGATION.intersection(parts) and out.intersection(parts):
                    return True
        if (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def _tags(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name or None, closing, attributes) of each piece of markup.
    A quoted value may hold `>`; once a quote isn't closed, the rest of the page
    is read without quotes, so that no part is read more than twice."""
    at, quotes = 0, True
    while m := _OPEN.search(html, at):
        if m[3]:
            found = _COMMENT_END.search(html, m.end())
            at = found.end() if found else len(html)
            yield m.start(), at, None, False, ""
            continue
        close = html.find(">", m.end())
        if close < 0:
            begin = html.find("<!--", m.end())
            if begin >= 0:
                yield begin, len(html), None, False, ""
            return
        if m[2] is None:
            at = close + 1
            yield m.start(), at, None, False, ""
            continue
        end, where = -1, m.end()
        while quotes and end < 0:
            n = _INSIDE.search(html, where)
            if n and not n[1]:
                end = n.start()
                break
            where = html.find(n[1], n.end()) + 1 if n else 0
            quotes = where > 0
        end = close if end < 0 else end
        at = end + 1
        skip = yield m.start(), at, m[2].lower(), bool(m[1]), html[m.end() : end]
        if skip:
            at = skip
            yield at, at, None, False, ""


class _Tree:
    """Nodes by number, parents before children; `out` is each node's own mark,
    and `core` tells what is or is within an article or main element; events in page order are
    (node, text) or (node, None) at a block's edge."""

    def __init__(self, html: str):
        self.tag, self.up, self.out, self.core = ["body"], [-1], [False], [False]
        self.events: list[tuple[int, str | None]] = []
        stack, names, blocks = [0], ["body"], [0]
        where: dict[str, list[int]] = {}
        tag, up, out, core, events = self.tag, self.up, self.out, self.core, self.events

        def last(of) -> int:
            """Depth of the innermost open element of these names."""
            return max((where[n][-1] for n in of if where.get(n)), default=0)

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                name, node = names.pop(), stack.pop()
                where[name].pop()
                if name in BLOCK:
                    blocks.pop()
                    events.append((node, None))

        at, tags = 0, _tags(html)
        for begin, end, name, closing, attrs in tags:
            if begin > at:
                events.append((stack[-1], html[at:begin]))
            at = end
            if name is None or name in ("html", "body"):
                continue
            if closing:
                depth = last((name,))
                if depth and (name in BLOCK or blocks[-1] < depth):
                    pop_to(depth)
                continue
            if name in BLOCK and (depth := last(("p",))) > last(("table", "button", "object")):
                pop_to(depth)
            if name in CLOSES:
                closed, stop = CLOSES[name]
                while (depth := last(closed)) > last(stop):
                    pop_to(depth)
                    if name != "tr":
                        break
            parent, node = stack[-1], len(tag)
            tag.append(name)
            up.append(parent)
            core.append(core[parent] or name in ("article", "main"))
            out.append(_is_out(name, attrs, core[parent]))
            if name in BLOCK:
                events.append((node, None))
            elif name == "br":
                events.append((parent, " "))
            if name in RAW:
                found = _RAW_END[name].search(html, at)
                at = found.end() if found else len(html)
                tags.send(at)
                continue
            if name in VOID or attrs.endswith("/") and name in ("svg", "path"):
                continue
            where.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            names.append(name)
        if at < len(html):
            events.append((stack[-1], html[at:]))
        pop_to(1)


def _density(c: int, t: int, lc: int, lt: int, ratio: float) -> float:
    if not c:
        return 0.0
    lc1, lt1, t1 = max(lc, 1), max(lt, 1), max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
    return c / t1 * math.log(max(c / lc1 * t1 / lt1, 1)) / math.log(max(base, 1.0001)) if base > 1 else c / t1


def _left_out(tree: _Tree, words: bool = True) -> list[bool]:
    """Nodes that count for nothing; without `words` only those that never do."""
    n, tag, up = len(tree.tag), tree.tag, tree.up
    never, link = [False] * n, [False] * n
    for k in range(1, n):
        never[k] = never[up[k]] or tag[k] in NEVER
        link[k] = link[up[k]] or tag[k] == "a"
    if not words:
        return never
    text, core = [0] * n, 0
    holds = [tag[k] in ("article", "main") and not tree.out[k] for k in range(n)]
    for node, t in tree.events:
        if t is not None and not never[node] and not link[node]:
            text[node] += len("".join(t.split()))
    within = holds[:]
    for k in range(1, n):
        within[k] = within[k] or within[up[k]]
        core += text[k] if within[k] else 0
    for k in range(n - 1, 0, -1):
        text[up[k]] += text[k]
        holds[up[k]] = holds[up[k]] or holds[k]
    out = never[:]
    for k in range(1, n):
        if tree.out[k] and not never[k] and not holds[k]:
            other = core - (text[k] if within[k] else 0)
            out[k] = text[k] < WRAPS * text[0] or not text[k] or other >= ELSEWHERE * text[0]
        out[k] = out[k] or out[up[k]]
    return out


def extract(html: str | None) -> str:
    """The main text of one whole page."""
    if not html:
        return ""
    tree = _Tree(html)
    return _main(tree, _left_out(tree)) or _main(tree, _left_out(tree, words=False))


def _main(tree: _Tree, out: list[bool]) -> str:
    n, tag, up = len(tree.tag), tree.tag, tree.up
    chars, tags, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    events = [(node, text if text is None else unescape(text)) for node, text in tree.events if not out[node]]
    for node, text in events:
        if text is not None:
            chars[node] += len("".join(text.split()))
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[up[k]] or tag[k] == "a"
    for k in range(n - 1, -1, -1):
        if in_link[k]:
            link_chars[k] = chars[k]
        if k and not out[k]:
            p = up[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + 1
            links[p] += links[k] + (tag[k] == "a")
    ratio = link_chars[0] / max(1, chars[0])
    density = [_density(chars[k], tags[k], link_chars[k], links[k], ratio) for k in range(n)]
    total = [0.0] * n
    for k in range(1, n):
        if not out[k]:
            total[up[k]] += density[k]
    best = max(range(n), key=lambda k: (total[k], -k) if not out[k] else (-1.0, -k))
    path = [best]
    while path[-1]:
        path.append(up[path[-1]])
    core = [k for k in path if tag[k] in ("article", "main")]
    if core:
        chosen = {core[-1]}
    else:
        least = min(density[k] for k in path)
        below = list(range(n))
        for k in range(n - 1, 0, -1):
            p = up[k]
            if not out[k] and total[below[k]] > total[below[p]]:
                below[p] = below[k]
        on_path = set(path)
        chosen = {best}
        for k in range(1, n):
            if not out[k] and k not in on_path and up[k] in on_path and up[k] != best and density[k] >= least and link_chars[k] * 2 < chars[k]:
                chosen.add(below[k] if total[below[k]] > 0 else k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in chosen or (k > 0 and inside[up[k]])
    blocks, now = [], []
    for node, text in events:
        if text is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif inside[node]:
            now.append(text)
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(h) for h in b["html"]]})


def main_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    rows = pages.select(id_text("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = with_id(rows.mapInPandas(_extract, "page_id string, url string, text string"), "page_id")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_composite_text_density(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return main_text(table(spark, sf_dir, "pages"))
