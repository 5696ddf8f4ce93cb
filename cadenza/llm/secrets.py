"""Secret scan: one combined deterministic automaton over whole texts.

All rules' patterns become one minimal automaton (automaton.py) that reads bytes
from the end and tells, at each byte, which rules have a match that begins there.
Texts are joined to one byte buffer and cut at bytes that no match can hold, so
that no match crosses a cut; all cells then advance together, one table lookup a
byte, whatever the number of rules. Spans are leftmost-longest and do not overlap
within a rule: from the leftmost place where a match begins, a second combined
automaton is followed to that match's end. No place is tried in vain and no byte
of a match is read again for the same rule, so time grows with the text on any
text, as long as a rule's pattern ends in a run or a fixed part. Spans are in
code points.

A null text is empty. Every row gets a result, repeated ids included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Walker, backward, compile_trees, parse, scan_backward, shortest
from .common import id_text, with_id

CELL = 384


@dataclass(frozen=True)
class Rule:
    """`head` then `tail`; a span counts if it has `least` bytes, and its part
    after the head `least_tail`. `fold`: letters in either case."""

    kind: str
    head: str
    tail: str
    least: int = 0
    least_tail: int = 0
    fold: bool = False

    @property
    def pattern(self) -> str:
        return self.head + self.tail


BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", least_tail=6, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", least=20),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]+", least=39),
    Rule("payment", "[sr]k_(live|test)_", "[A-Za-z0-9]+", least=24),
    Rule("web_token", "eyJ", r"[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)


class Scanner:
    """The rules' automata: one that, read backwards, tells where any rule's
    match begins, and one that follows all rules from such a place."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.starts = compile_trees([backward(shortest(t)) for t in trees], floating=True)
        follow = compile_trees(trees, floating=False)
        self.follow = Walker(follow)
        self.head = [Walker(compile_trees([parse(r.head, r.fold)], floating=False)) if r.least_tail else None for r in rules]
        self.reset = self.starts.resets() & follow.ends()
        if not self.reset[10]:
            raise ValueError("a rule's match can hold a line feed: texts could not be joined")

    def spans_of(self, k: int, data: bytes, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Leftmost-longest spans of rule k, of which these are all the places
        where a match begins; a span beneath the rule's least still counts as
        passed."""
        rule, i = self.rules[k], 0
        while i < len(starts):
            at = int(starts[i])
            end = self.follow.longest(data, at, k)
            if end - at >= rule.least and (not rule.least_tail or end - self.head[k].longest(data, at) >= rule.least_tail):
                yield at, end
            i += int(np.searchsorted(starts[i:], end))

    def find(self, texts: list[str | None]) -> dict[int, list[tuple[int, int, int]]]:
        """text number -> [(start, rule number, end)] in code points, by start."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = b"\n".join(raw)
        data = np.frombuffer(whole, np.uint8)
        if not len(data):
            return {}
        texts_at = np.cumsum([0] + [len(r) + 1 for r in raw])
        cuts = np.flatnonzero(self.reset[data])
        pick = np.unique(np.searchsorted(cuts, np.arange(CELL, len(data), CELL)))
        begin = np.unique(np.concatenate(([0], cuts[pick[pick < len(cuts)]])))
        places, bits = scan_backward(self.starts, data, begin, np.diff(np.append(begin, len(data))))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k in range(len(self.rules)):
            for s, e in self.spans_of(k, whole, places[bits >> k & 1 == 1]):
                doc = int(np.searchsorted(texts_at, s, "right")) - 1
                out.setdefault(doc, []).append((s - int(texts_at[doc]), k, e - int(texts_at[doc])))
        for doc, spans in out.items():
            spans.sort()
            if not raw[doc].isascii():
                points = np.concatenate(([0], np.cumsum((np.frombuffer(raw[doc], np.uint8) & 0xC0) != 0x80)))
                out[doc] = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        return out


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = scanner(rules)
        for b in batches:
            found = engine.find(b["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "spans": [[(rules[k].kind, s, e) for s, k, e in found.get(i, [])] for i in range(len(b))],
                }
            )

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, stop>>
    (code points, end exclusive, by start and then by the rules' order)."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(_scan(rules), "doc_id string, spans array<struct<kind:string,start:long,stop:long>>")
    return with_id(found, "doc_id")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
