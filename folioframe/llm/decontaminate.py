"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on Karp-Rabin fingerprints of shared runs of
tokens (seeds). Seeds on one diagonal make maximal matches; the longest match that no tile
covers is marked again and again until none of the least length is left. An item
leaks into a document if the tiles cover enough of it, in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, batch_of, mix, row_index, slices, text_words

#: Tokens of the shortest tile, and the covered share of an item that makes a leak.
LEAST, COVER = 5, 0.6
#: Bytes of benchmark text that are broadcast at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 << 20
#: Seeds of documents and items that are joined at once.
SEEDS = 1 << 20


def fingerprints(words: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of every run of ``least`` words that stays inside its row."""
    n = max(len(words) - least + 1, 0)
    h = np.zeros(n, U64)
    for k in range(least):
        h = h * U64(0xD1342543DE82EF95) + words[k : k + n]
    start = np.arange(n)
    inside = start + least <= np.repeat(at[1:], np.diff(at))[:n]
    return start[inside], mix(h[inside])


def folded(texts: pa.Array) -> pa.Array:
    """Texts without case: every character's upper case in lower case, and ss for ß. Bytes that are not UTF-8 become U+FFFD."""
    try:
        upper = pc.utf8_upper(texts)
    except pa.ArrowInvalid:
        upper = pc.utf8_upper(pa.array([None if t is None else t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.large_string()))
    return pc.replace_substring(pc.utf8_lower(upper), "ß", "ss")


def folded_slices(column: pa.Array, rows: int = 500) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``slices`` of folded texts; so many rows are folded at once."""
    for first in range(0, len(column), rows):
        for a, b, buf, offs in slices(folded(column.slice(first, rows))):
            yield first + a, first + b, buf, offs


class Benchmark:
    """Seeds of a block of items, sorted by fingerprint."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST):
        self.least, self.ids, self.words, offset = least, ids, [], 0
        hashes, item, place = [], [], []
        for _, _, buf, offs in slices(folded(pa.array(texts, pa.large_string()))):
            w, at = text_words(buf, offs)
            self.words += np.split(w, at[1:-1])
            start, h = fingerprints(w, at, least)
            row = row_index(at)[start] if len(start) else start
            hashes.append(h)
            item.append(row + offset)
            place.append(start - at[row])
            offset += len(offs) - 1
        h = np.concatenate(hashes) if hashes else np.empty(0, U64)
        order = np.argsort(h, kind="stable")
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hash & U64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, place among the block's fingerprints) of the runs of words that some item has."""
        start, h = fingerprints(words, at, self.least)
        near = np.flatnonzero(self.sieve[(h & U64((1 << 20) - 1)).astype(np.int64)])
        if not len(near) or not len(self.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, h = start[near], h[near]
        slot = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[slot] == h
        return start[hit], slot[hit]

    def postings(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(postings of each slot, end to end, and how many each has)."""
        many = self.count[slot]
        return np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum()), many

    def leaks(self, words: np.ndarray, at: np.ndarray, cover: float = COVER, at_once: int = SEEDS) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, covered share, tiles) of every leak in a slice, row by row.

        Seeds are joined for as many rows as give ``at_once`` of them; a row with more (repeated tokens in it and in
        items) is compared item by item along diagonals, in memory of the texts' sizes.
        """
        start, slot = self.hits(words, at)
        row = np.searchsorted(at, start, "right") - 1
        seeds = np.bincount(row, self.count[slot], len(at) - 1)
        block = np.cumsum(np.minimum(seeds, at_once)) // max(at_once, 1)
        for k in np.unique(block[row]).tolist():
            own = np.flatnonzero((block[row] == k) & (seeds[row] <= at_once))
            yield from self._joined(row[own], start[own] - at[row[own]], slot[own], cover)
            for r in np.flatnonzero((block == k) & (seeds > at_once)).tolist():
                yield from self._along_diagonals(r, words[at[r] : at[r + 1]], np.unique(slot[row == r]), cover)

    def _joined(self, row: np.ndarray, place: np.ndarray, slot: np.ndarray, cover: float) -> Iterator[tuple[int, int, float, int]]:
        if not len(row):
            return
        post, many = self.postings(slot)
        row, x, item, y = np.repeat(row, many), np.repeat(place, many), self.item[post], self.place[post]
        order = np.lexsort((y, item, row))
        row, item, x, y = row[order], item[order], x[order], y[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        group = np.cumsum(new) - 1
        # tiles cover at most the union of the seeds in the item: others need no tiling
        step = np.full(len(row), self.least)
        step[:-1] = np.where(new[1:], self.least, np.minimum(y[1:] - y[:-1], self.least))
        most = np.bincount(group, step)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(row))
        for g in np.flatnonzero(most >= cover * self.length[item[heads]] - 1e-9).tolist():
            a, b = heads[g], ends[g]
            yield from self._judged(int(row[a]), int(item[a]), tile(x[a:b], y[a:b], self.least), cover)

    def _along_diagonals(self, r: int, x: np.ndarray, slots: np.ndarray, cover: float) -> Iterator[tuple[int, int, float, int]]:
        post, _ = self.postings(slots)
        items = np.unique(self.item[post])
        for i in items.tolist():
            y = np.unique(self.place[post[self.item[post] == i]])
            most = np.minimum(np.diff(y), self.least).sum() + self.least
            if most >= cover * self.length[i] - 1e-9:
                yield from self._judged(r, i, tile_matches(*diagonal_matches(x, self.words[i], self.least), self.least), cover)

    def _judged(self, row: int, item: int, tiles: list, cover: float) -> Iterator[tuple[int, int, float, int]]:
        n, covered = int(self.length[item]), sum(t[2] for t in tiles)
        if covered >= cover * n - 1e-9:
            yield row, item, covered / n, len(tiles)


def diagonal_matches(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, length) of every maximal common run of ``least`` tokens or more, one diagonal after the other."""
    out = []
    for d in range(least - len(y), len(x) - least + 1):
        a, b = max(d, 0), max(-d, 0)
        n = min(len(x) - a, len(y) - b)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x[a : a + n] == y[b : b + n], [False]]).view(np.int8)))
        first, end = edge[::2], edge[1::2]
        long = end - first >= least
        if long.any():
            out.append(np.stack([a + first[long], b + first[long], (end - first)[long]]))
    return tuple(np.concatenate(out, 1)) if out else tuple(np.empty((3, 0), np.int64))


def tile(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (x, y, length) from seeds at (x, y)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = ((x - y)[1:] != (x - y)[:-1]) | (x[1:] - x[:-1] > 1)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(x)) - 1
    return tile_matches(x[heads], y[heads], x[last] - x[heads] + least, least)


def tile_matches(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal matches: the longest free match first.

    Equal lengths go by the smaller x, then the smaller y. A match that tiles cut is
    put back by its free parts of ``least`` tokens or more.
    """
    heap = list(zip((-n).tolist(), x.tolist(), y.tolist()))
    heapq.heapify(heap)
    used_x, used_y = (np.zeros(int((v + n).max(initial=0)), bool) for v in (x, y))
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        used = used_x[a : a + n] | used_y[b : b + n]
        if not used.any():
            tiles.append((a, b, n))
            used_x[a : a + n] = used_y[b : b + n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).view(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i >= least:
                heapq.heappush(heap, (i - j, a + i, b + i))
    return tiles


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[Benchmark]:
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // limit) if size > limit else 1)
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()  # about limit / 2 bytes
        yield Benchmark(got["item_id"].to_pylist(), got["text"].to_pylist())


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per leak: doc_id, item_id, coverage (of the item's tokens), n_tiles. Other columns are not read.

    Tokens are runs of letters and digits, without case (``folded``). Null and empty texts and items under
    LEAST tokens have no leaks; repeated rows give repeated leaks; items with a null id leak under a null id; an empty table gives none. The
    benchmark is compared in blocks of bounded size, each in one scan of ``docs``.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())])
    spark = docs.sparkSession

    def scan(block: Benchmark) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, offs in folded_slices(batch.column(1)):
                    found = list(shared.value.leaks(*text_words(buf, offs), cover))
                    if found:
                        rows = batch.column(0).slice(a, b - a).take(pa.array([f[0] for f in found]))
                        yield batch_of(schema, rows, [shared.value.ids[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found])

        return texts.mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles long")

    return reduce(DataFrame.unionByName, map(scan, _blocks(benchmark, block_bytes)))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without those ``find_leaks`` reports.

    Null and empty texts stay, null ids and repeated rows are judged by their texts alone, an empty table gives no
    rows, and columns of any name pass through.
    """
    place, spark = docs.columns.index("text"), docs.sparkSession
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, offs in folded_slices(batch.column(place)):
                    keep = np.ones(b - a, bool)
                    keep[[f[0] for f in shared.value.leaks(*text_words(buf, offs), cover)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
