"""Secret scan over a segmented trigram inverted index.

Every slice of texts is an index segment: the postings (rows) of all its trigrams, sorted by trigram. Each
rule's Boolean trigram query, derived once from its regular expression, is answered by intersecting
and uniting postings, and only candidate rows are verified with the expression itself. A rule without
mandatory trigrams scans every row. Trigrams are those of the UTF-8 bytes with A-Z folded. Segments need no
shuffle and memory is bounded by the slice; ``build_index`` keeps them as a table that ``search_index`` answers
further rules from.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._kernels import U64, batch_of, distinct, slices


@dataclass(frozen=True)
class Rule:
    """``least`` characters are required of ``group``; failing matches are dropped."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules in their listed order, then the rules this scan adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),  # maximal runs: the same spans as [0-9a-f]+ of 24 or more
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

_MOST = 64  # strings kept exactly while a query is derived


def _trigrams(strings: set[str]):
    """OR over strings of AND over their trigrams; True where one has none."""
    if any(len(s) < 3 for s in strings):
        return True
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _and(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def _forms(c: int, flags: int) -> set[str] | None:
    """The folded bytes of a character, one letter a byte; None if it matches others that fold to other bytes."""
    if flags & re.IGNORECASE and not flags & re.ASCII and (c > 127 or chr(c) in "iIkKsS"):
        return None  # dotted and dotless i, long s and the kelvin sign fold to ASCII letters
    if 0xD800 <= c < 0xE000:
        return None
    return {chr(c).encode().lower().decode("latin-1")}


def _exact(op, arg, flags: int) -> set[str] | None:
    """All folded strings of one parsed node, or None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return _forms(arg, flags)
    if name == "IN":
        out: set[str] = set()
        for o, a in arg:
            if str(o) not in ("LITERAL", "RANGE") or str(o) == "RANGE" and a[1] - a[0] >= 8:
                return None
            for c in [a] if str(o) == "LITERAL" else range(a[0], a[1] + 1):
                one = _forms(c, flags)
                if one is None:
                    return None
                out |= one
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _exact_all(arg[-1], (flags | arg[1]) & ~arg[2])
    if name == "BRANCH":
        sets = [_exact_all(b, flags) for b in arg[1]]
        return None if any(s is None for s in sets) or sum(map(len, sets)) > _MOST else set().union(*sets)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 8:
        one = _exact_all(arg[2], flags)
        if one is None or sum(len(one) ** k for k in range(arg[0], arg[1] + 1)) > _MOST:
            return None
        out, now = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
        return out
    return {""} if name == "AT" else None


def _exact_all(nodes, flags: int) -> set[str] | None:
    now = {""}
    for op, arg in nodes:
        one = _exact(op, arg, flags)
        if one is None or len(now) * len(one) > _MOST:
            return None
        now = {a + b for a in now for b in one}
    return now


def _query(nodes, flags: int):
    parts, run = [], {""}
    for op, arg in nodes:
        one = _exact(op, arg, flags)
        if one is not None and len(run) * len(one) <= _MOST:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_trigrams(run))
        run = one or {""}
        if one is None:
            name = str(op)
            if name == "SUBPATTERN":
                parts.append(_query(arg[-1], (flags | arg[1]) & ~arg[2]))
            elif name == "BRANCH":
                parts.append(_or([_query(b, flags) for b in arg[1]]))
            elif name.endswith("REPEAT") and arg[0]:
                parts.append(_query(arg[2], flags))
    return _and([*parts, _trigrams(run)])


def trigram_query(pattern: str, flags: int = re.ASCII):
    """A Boolean query of folded trigrams that every match's text satisfies.

    A string of three bytes as letters, ("and", ...), ("or", ...), or True when nothing is mandatory.
    """
    parsed = sre.parse(pattern, flags)
    return _query(parsed, flags | parsed.state.flags)


class Segment:
    """The inverted index of a slice of texts: sorted trigrams, where the postings of each end, and the postings."""

    def __init__(self, rows: int, codes: np.ndarray, ends: np.ndarray, post: np.ndarray):
        self.rows, self.codes, self.ends, self.post = rows, codes, ends, post

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> Segment:
        low = np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(U64)
        n = max(len(buf) - 2, 0)
        inside = np.ones(n, bool)
        for k in (1, 2):
            cut = offs[1:-1] - k
            inside[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(inside)
        code = (low[at] << U64(16) | low[at + 1] << U64(8) | low[at + 2]) << U64(32)
        pairs = distinct(code | (np.searchsorted(offs, at, "right") - 1).astype(U64))
        codes, many = np.unique((pairs >> U64(32)).astype(np.uint32), return_counts=True)
        return cls(len(offs) - 1, codes, np.cumsum(many).astype(np.uint32), (pairs & U64(0xFFFFFFFF)).astype(np.uint32))

    def postings(self, trigram: str) -> np.ndarray:
        code = int.from_bytes(trigram.encode("latin-1"), "big")
        k = int(np.searchsorted(self.codes, code))
        if k == len(self.codes) or self.codes[k] != code:
            return self.post[:0]
        return self.post[self.ends[k - 1] if k else 0 : self.ends[k]]

    def answer(self, q) -> np.ndarray:
        """Sorted rows that satisfy a trigram query; all rows where nothing is mandatory."""
        if q is True:
            return np.arange(self.rows, dtype=np.uint32)
        if isinstance(q, str):
            return self.postings(q)
        parts = sorted(map(self.answer, q[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def derived(rules: tuple[Rule, ...]) -> list:
    return [trigram_query(r.pattern, r.flags) for r in rules]


def scan_segment(segment: Segment, texts: list[str], rules: tuple[Rule, ...], queries: list) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every row, sorted, in code points."""
    found: list[list] = [[] for _ in texts]
    for k, (rule, q) in enumerate(zip(rules, queries)):
        find = re.compile(rule.pattern, rule.flags).finditer
        for i in segment.answer(q).tolist():
            for m in find(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for f in found:
        f.sort()
    return found


def scan_texts(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """The spans of every text, slice by slice."""
    column, queries = pa.array(texts, pa.string()), derived(rules)
    return [f for a, b, buf, offs in slices(column) for f in scan_segment(Segment.of(buf, offs), [t or "" for t in texts[a:b]], rules, queries)]


_KIND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_KIND))])
_FOUND_DDL = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def _spans(found: list[list[tuple[int, int, int]]], rules: tuple[Rule, ...]) -> list:
    return [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in f] for f in found]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end, base).

    Spans are in code points, end exclusive, by start and then rule order. Null and
    empty texts give an empty array; repeated rows give repeated results; an empty
    table gives no rows. Other input columns are not read. Segments are made, asked and given up in one pass.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    queries = derived(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield batch_of(_FOUND, batch.column(0).slice(a, b - a), _spans(scan_segment(Segment.of(buf, offs), texts, rules, queries), rules))

    return docs.mapInArrow(run, _FOUND_DDL)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table, a row a segment: ids and texts of its rows, and its trigrams, ends and postings as
    little-endian 32-bit integers. Write it once to ask it for rules that come later; nulls as in ``scan_secrets``."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("trigrams", pa.binary()), ("ends", pa.binary()), ("postings", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1)):
                s, own = Segment.of(buf, offs), batch.slice(a, b - a)
                yield batch_of(schema, *([own.column(c).to_pylist()] for c in range(2)), *([x.tobytes()] for x in (s.codes, s.ends, s.post)))

    return docs.mapInArrow(run, "doc_ids array<long>, texts array<string>, trigrams binary, ends binary, postings binary")


def search_index(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What ``scan_secrets`` gives, from a kept index."""
    queries = derived(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(len(row["texts"]), *(np.frombuffer(row[c], np.uint32) for c in ("trigrams", "ends", "postings")))
                yield batch_of(_FOUND, row["doc_ids"], _spans(scan_segment(segment, [t or "" for t in row["texts"]], rules, queries), rules))

    return index.select("doc_ids", "texts", "trigrams", "ends", "postings").mapInArrow(run, _FOUND_DDL)


def digest(df: DataFrame) -> DataFrame:
    """The count, digest and text columns of a scan, by built-in functions."""
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.base and s.kind = '{0}')) as long) n_{0}"
    return df.selectExpr(
        "doc_id", *(count.format(k) for k in ("assign", "access", "hex")),
        f"sha2({joined.format('filter(spans, s -> s.base)')}, 256) base_sha256", f"{joined.format('spans')} spans",
    )
