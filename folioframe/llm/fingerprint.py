"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces.

A text is cut, at content-defined word starts and at every line, into pieces whose digests
form a set. A sketch is a table of cells holding counts and sums of digests; two
sketches subtract cell by cell, and peeling cells with a single digest recovers the
digests on which the texts differ. When peeling stops early, the pair is tried again
with a table four times as large. All rows of a slice peel together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import SLICE_BYTES, U64, batch_of, distinct, mix, prefix_hash, row_index, span_hash, word_spans

#: Cells of the sketch in the fingerprint column (a multiple of 3), and of the first try.
CELLS = 12
GROW = 4
_LOWEST = -(1 << 63)


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit digests of each row's pieces, sorted, and offsets by row.

    A piece begins at a row's start, after a line end, and at a word with an odd hash; it runs to
    the next one, white space included. Repeats of a piece get digests by their number.
    """
    n = len(buf)
    h = prefix_hash(buf)
    starts, ends, _ = word_spans(buf, offs)
    odd = starts[(span_hash(h, starts, ends) & U64(1)).astype(bool)]
    cuts = distinct(np.concatenate([offs[:-1], odd, np.flatnonzero(buf == 10) + 1]))
    cuts = cuts[cuts < n]
    row = np.searchsorted(offs, cuts, "right") - 1
    digest = span_hash(h, cuts, np.append(cuts[1:], n)) if len(cuts) else np.empty(0, U64)
    order = np.lexsort((digest, row))
    digest, row = digest[order], row[order]
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(digest))
    number = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(digest) else place
    return mix(digest + number.astype(U64) * U64(0x9E3779B97F4A7C15)), np.searchsorted(row, np.arange(len(offs)))


def cells_of(keys: np.ndarray, row: np.ndarray, cells: int) -> np.ndarray:
    """(3, items): the cell of each key in each third of its row's table."""
    third = cells // 3
    return np.stack([row * cells + k * third + (mix(keys ^ U64(0xA5A5 + cells * 8 + k)) % U64(third)).astype(np.int64) for k in range(3)])


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ U64(0xC3C3C3C3C3C3C3C3)) & U64(0xFFFFFFFF)


class Sketches:
    """Tables of ``cells`` cells for several rows; add with sign +1 or -1, then peel."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells = rows, cells
        self.count = np.zeros(rows * cells, np.int64)
        self.keys, self.checks = np.zeros(rows * cells, U64), np.zeros(rows * cells, U64)

    def add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        factor, check = sign.astype(U64), check_of(keys)
        for at in cells_of(keys, row, self.cells):
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * factor)
            np.add.at(self.checks, at, check * factor)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests recovered by row, whether all of the row's were)."""
        found = np.zeros(self.rows, np.int64)
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            sign = self.count[at]
            keys = self.keys[at] * sign.astype(U64)
            pure = (np.abs(sign) == 1) & (self.checks[at] * sign.astype(U64) == check_of(keys))
            at, sign, keys = at[pure], sign[pure], keys[pure]
            row = at // self.cells
            _, first = np.unique(mix(keys ^ mix(row.astype(U64))), return_index=True)
            keys, row, sign = keys[first], row[first], sign[first]
            self.add(keys, row, -sign)
            found += np.bincount(row, minlength=self.rows)
            at = distinct(cells_of(keys, row, self.cells).ravel()) if len(keys) else keys
            at = at[np.abs(self.count[at]) == 1] if len(at) else at
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return found, ~left.reshape(self.rows, self.cells).any(1)

    def text(self) -> list[str]:
        """Each row's table as text."""
        raw = np.concatenate([x.reshape(self.rows, self.cells).astype(t).view(np.uint8).reshape(self.rows, -1) for x, t in ((self.count, "<i4"), (self.keys, "<u8"), (self.checks, "<u4"))], 1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


    def some(self, a: int, b: int) -> Sketches:
        """The tables of rows a to b."""
        out, cut = Sketches(0, self.cells), slice(a * self.cells, b * self.cells)
        out.rows, out.count, out.keys, out.checks = b - a, self.count[cut], self.keys[cut], self.checks[cut]
        return out

    def minus(self, other: Sketches) -> Sketches:
        """The cells of self less those of ``other``, row by row."""
        out = Sketches(0, self.cells)
        out.rows, out.count, out.keys, out.checks = self.rows, self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out


def differences(first: Sketches, second: Sketches, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Digests on which each pair of rows differs: the two sketches are subtracted and peeled, and where peeling
    stops early, sketches of the digests themselves, each time GROW times as large."""
    out, whole = first.minus(second).peel()
    todo, cells = np.flatnonzero(~whole), first.cells * GROW
    a_row, b_row = row_index(a_at), row_index(b_at)
    while len(todo):
        # a table far smaller than the difference in size cannot peel: such rows wait for a larger one
        gap = np.abs((a_at[todo + 1] - a_at[todo]) - (b_at[todo + 1] - b_at[todo]))
        ready = todo[gap <= cells]
        failed = []
        for some in np.array_split(ready, max(1, len(ready) * cells // (1 << 20))):
            if not len(some):
                continue
            slot = np.full(len(out), -1)
            slot[some] = np.arange(len(some))
            s = Sketches(len(some), cells)
            for keys, row, sign in ((a, a_row, 1), (b, b_row, -1)):
                own = slot[row] >= 0
                s.add(keys[own], slot[row[own]], sign)
            found, whole = s.peel()
            out[some[whole]] = found[whole]
            failed.append(some[~whole])
        todo = np.sort(np.concatenate([todo[gap > cells], *failed]))
        cells *= GROW
    return out


def likeness(d: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Shared digests over all: 1 for equal sets, both empty included."""
    return np.where(n_a + n_b == 0, 1.0, (n_a + n_b - d) / np.maximum(n_a + n_b + d, 1))


def compare_with_next(texts: list[bytes]) -> list[tuple]:
    """For all but the last text: (n_chars, edited digest, fingerprint, edited fingerprint, near_edited, near_next)."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    place = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    at = np.searchsorted(place, offs)
    chars = np.diff(at)
    rows = len(texts) - 1
    half = chars[:-1] // 2
    keep = place[at[:-2] + chars[:-1] - half] - offs[:-2]
    take = place[at[1:-1] + np.minimum(half, chars[1:])] - offs[1:-1]
    edited = [t[:k] + u[:m] for t, u, k, m in zip(texts, texts[1:], keep.tolist(), take.tolist())]
    e_offs = np.concatenate([[0], np.cumsum([len(t) for t in edited])])
    p, p_at = pieces(buf, offs)
    e, e_at = pieces(np.frombuffer(b"".join(edited), np.uint8), e_offs)
    own, own_at, nxt, nxt_at = p[: p_at[rows]], p_at[: rows + 1], p[p_at[1] :], p_at[1:] - p_at[1]
    n, n_e, n_next = np.diff(own_at), np.diff(e_at), np.diff(nxt_at)
    all_rows, second = Sketches(rows + 1, CELLS), Sketches(rows, CELLS)
    all_rows.add(p, row_index(p_at))
    second.add(e, row_index(e_at))
    first, third = all_rows.some(0, rows), all_rows.some(1, rows + 1)
    near_e = likeness(differences(first, second, own, own_at, e, e_at), n, n_e)
    near_n = likeness(differences(first, third, own, own_at, nxt, nxt_at), n, n_next)
    shas = [hashlib.sha256(t).hexdigest() for t in edited]
    return list(zip(chars[:-1].tolist(), shas, first.text(), second.text(), near_e.tolist(), near_n.tolist()))


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are in ascending order of ids, null ids first, and rows of one id in the order of their texts' hashes; the next
    of the last is the first, and of a single one itself. Null counts as empty; an empty table gives
    no rows; other columns are not read. Texts are dealt once, by ranges of ids; an id that fills several ranges is
    split by its texts' hashes. The first document of a range also goes to the range before it.
    """
    spark = docs.sparkSession
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    splits, many = np.unique(np.array(points, np.int64), return_counts=True)
    # an id that is a split point c times fills c - 1 ranges or more: it gets as many parts. Hashes of texts are asked for in that case only
    parts = np.concatenate([[1], many]).astype(np.int64)
    before_parts = np.cumsum(parts) - parts
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    docs = docs.select(key.alias("key"), (F.xxhash64(text) if len(points) > len(splits) else F.lit(0).cast("long")).alias("tie"), text.alias("text"))

    def ranges(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        base = np.searchsorted(splits, key, "right")
        c = parts[base]
        share = ((tie.astype(np.float64) + 2.0**63) / 2.0**64 * c).astype(np.int64)
        own = np.append(splits, 0)[base - 1] == key
        return (before_parts[base] + np.where(own & (base > 0), np.minimum(share, c - 1), c - 1)).astype(np.int32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranges(batch.column(0).to_numpy(), batch.column(1).to_numpy())), *batch.columns], ["pid", "key", "tie"])

    # one row per range: as many as partitions
    found = docs.select("key", "tie").mapInArrow(numbered, "pid int, key long, tie long").groupBy("pid").agg(F.min(F.struct("key", "tie")).alias("first")).collect()
    firsts = sorted((r["pid"], r["first"]["key"], r["first"]["tie"]) for r in found)
    before = {(k, t): firsts[i - 1][0] for i, (_, k, t) in enumerate(firsts)}
    heads = np.array(sorted(k for k, _ in before), np.int64)
    schema = pa.schema([("pid", pa.int32()), ("role", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield batch_of(schema, ranges(key, tie), np.zeros(len(key), np.int32), *batch.columns)
            head = np.array([i for i in np.flatnonzero(np.isin(key, heads)).tolist() if (int(key[i]), int(tie[i])) in before], np.int64)
            if len(head):
                at = pa.array(head)
                yield batch_of(schema, [before[k, t] for k, t in zip(key[head].tolist(), tie[head].tolist())], np.ones(len(head), np.int32), *(c.take(at) for c in batch.columns))

    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush(following: bytes) -> pa.RecordBatch:
            rows = compare_with_next([*texts, following])
            return batch_of(out, [None if i == _LOWEST else i for i in ids], *map(list, zip(*rows)))

        for batch in batches:
            data = batch.column(4).cast(pa.large_binary())
            for i, (role, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if role and not ids:
                    continue
                text = data[i].as_py()
                if role or held >= SLICE_BYTES:
                    yield flush(text)
                    ids, texts, held = [], [], 0
                if not role:
                    ids.append(key)
                    texts.append(text)
                    held += len(text)

    total = int(parts.sum())
    dealt = docs.mapInArrow(deal, "pid int, role int, key long, tie long, text string").repartitionById(max(n, total), F.col("pid"))
    return dealt.sortWithinPartitions("pid", "role", "key", "tie", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
