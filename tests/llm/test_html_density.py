"""Composite text density against a plain recursive version, and crafted pages."""

import math
import random
import time

from cadenza.llm.html_text import extract

rng = random.Random(6)


def grow(depth, linked=False):
    """A random element: (name, parts)."""
    parts = []
    for _ in range(rng.randint(0, 4)):
        if depth and rng.random() < 0.6:
            parts.append(grow(depth - 1, linked))
        else:
            parts.append(" ".join(rng.choice("ab cde fghij klmnopqr".split()) for _ in range(rng.randint(1, 25))))
    names = ["div", "section", "b", "em"] + ["a"] * (not linked)
    name = rng.choice(names)
    return ("a", [p for p in parts if isinstance(p, str)]) if name == "a" else (name, parts)


def html_of(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(html_of, node[1])) + f"</{node[0]}>"


def walk(node, path=()):
    yield node, path
    for k, part in enumerate(node[1]):
        if not isinstance(part, str):
            yield from walk(part, (*path, k))


def chars(node, linked=None):
    """Characters beneath a node, all or those in links."""
    total = 0
    for p in node[1]:
        if isinstance(p, str):
            total += len("".join(p.split())) if linked is None or node[0] == "a" else 0
        else:
            total += chars(p, linked)
    return total


def brute(root):
    nodes = dict((path, node) for node, path in walk(root))
    page = chars(root)
    ratio = chars(root, True) / max(1, page)

    def density(path):
        node = nodes[path]
        c, lc = chars(node), chars(node, True)
        below = [n for n, p in walk(node) if p]
        t, lt = len(below), sum(n[0] == "a" for n in below)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        if base <= 1:
            return c / max(t, 1)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(max(base, 1.0001))

    order = sorted(nodes)
    dens = {p: density(p) for p in order}
    total = {p: sum(dens[q] for q in order if len(q) == len(p) + 1 and q[: len(p)] == p) for p in order}
    best = max(order, key=lambda p: total[p])
    spine = [best[:k] for k in range(len(best) + 1)]
    least = min(dens[p] for p in spine)
    chosen = {best}
    for p in order:
        if p and p not in spine and p[:-1] in spine and p[:-1] != best and dens[p] >= least and chars(nodes[p], True) * 2 < chars(nodes[p]):
            top = max((q for q in order if q[: len(p)] == p), key=lambda q: total[q])
            chosen.add(top if total[top] > 0 else p)
    blocks, now = [], []

    def edge():
        if now:
            blocks.append(" ".join("".join(now).split()))
            now.clear()

    def tell(node, path, inside):
        inside = inside or path in chosen
        if node[0] in ("div", "section"):
            edge()
        for k, part in enumerate(node[1]):
            if isinstance(part, str):
                if inside:
                    now.append(part)
            else:
                tell(part, (*path, k), inside)
        if node[0] in ("div", "section"):
            edge()

    tell(root, (), False)
    edge()
    return "\n".join(b for b in blocks if b)


def test_equals_the_plain_version():
    full = 0
    for _ in range(400):
        root = ("body", [grow(4) for _ in range(rng.randint(1, 4))])
        want = brute(root)
        assert extract("<body>" + "".join(map(html_of, root[1])) + "</body>") == want
        full += bool(want)
    assert full > 200


def test_crafted_pages_take_linear_time():
    k = 60_000
    pages = [
        '<a "x ' * k, "<a b=\"x " * k, "<a b=\"x " * k + ">", "<b>" * k + "<li>x" * k, "<p><b>" * k, "<" * 5 * k, "<!--" * k, "<!-- " * k + "-->", "</b" * k, "<a " + "b" * 5 * k + ">x</a>",
        "<script>" * k, "<table><tr><td>" * k, "<ul><li>" * k + "</ul>" * k, "<a b='\">" * k, "&amp" * k, "<a b= " + " " * 5 * k + "c>x", "<i></p>" * k,
    ]
    begin = time.process_time()
    for p in pages:
        extract(p)
    assert time.process_time() - begin < 60


def test_markup_of_all_kinds():
    assert extract("<p>a<br>b <!-- c > --> d <!doctype x> e </ > f<p title='>' x=\">\">g</p><script>var s = '<p>no</p>'</script>h") == "a b d e f\ng\nh"
    assert extract("one <b two") == "one <b two"
    assert extract("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>") == "a\nb\nc\nd\ne"
    assert extract("x < y and <3 z") == "x < y and <3 z"
