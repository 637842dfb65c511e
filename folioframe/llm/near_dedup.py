"""MinHash near-dedup by a multi-index Hamming join.

Every document's shingle set gets a signature of POSITIONS b-bit MinHash symbols. The
signature is split into CHUNKS chunks; two signatures that differ in at most DISTANCE =
CHUNKS * (ERRORS + 1) - 1 positions agree in some chunk up to ERRORS positions (pigeonhole), so
each chunk is indexed under every choice of ERRORS wildcard positions and all such
pairs meet in a bucket. Equal sets are one node from the start. First the members of a bucket try the
nearest by signature, and links confirmed on the full sets are contracted. Then, in every bucket that is not
one component, each member outside the largest component meets all members of other components: the only
pairs ruled out are those whose sizes or parity bit maps prove the similarity too small (a bit that
differs is a shingle that only one of the sets has), and the rest is confirmed on the full sets. Of the pairs
that meet in a bucket none is lost to chance, and groups of copies never make all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, batch_of, mix, shingles, slices, word_hashes
from ._shared import Scratch, stored

SHINGLE = 5
POSITIONS, CHUNKS, ERRORS = 32, 8, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Rows of this number or fewer (four integers each, so 16 MB at most) may be broadcast as join keys; beyond, a shuffle joins.
BROADCAST_ROWS = 400_000
#: Links that one task contracts.
LINKS = 500_000
#: Members of a bucket that are compared at once; larger buckets are dealt into blocks.
BLOCK = 2048
#: Nearest members that are tried first.
NEAREST = 2
#: Bits of a parity bit map: four for a shingle, a power of two within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Array elements that a comparison holds at once.
AT_ONCE = 1 << 21

_SEEDS = np.random.default_rng(97).integers(1, 1 << 63, (POSITIONS, 2), dtype=np.uint64)
_WILD = list(combinations(range(POSITIONS // CHUNKS), ERRORS))


def sorted_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes by row, and their offsets."""
    h, at = shingles(*word_hashes(buf, offs), size)
    keep = np.ones(len(h), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            own = h[a:b]
            own.sort()
            keep[a + 1 : b] = own[1:] != own[:-1]
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, POSITIONS) 16-bit MinHash symbols; rows without shingles get zeros."""
    rows = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, POSITIONS), np.uint16)
    if len(rows):
        for k, (a, b) in enumerate(_SEEDS):
            least = np.minimum.reduceat((sets ^ b) * (a | U64(1)), at[rows])
            out[rows, k] = (mix(least) >> U64(48)).astype(np.uint16)
    return out


def map_bits(n: int) -> int:
    """Bits of the parity bit map of a set of ``n`` shingles."""
    return min(max(LEAST_BITS, 1 << (4 * n - 1).bit_length()), MOST_BITS) if n else LEAST_BITS


def parity_map(items: np.ndarray) -> bytes:
    """The parity bit map of one set: bit k tells whether an odd number of its hashes end in k."""
    bits = map_bits(len(items))
    odd = np.bincount((mix(items) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * wildcards) 64-bit keys: each chunk with ERRORS positions left out."""
    width, keys = POSITIONS // CHUNKS, []
    for c in range(CHUNKS):
        for w, wild in enumerate(_WILD):
            key = np.full(len(sig), c * len(_WILD) + w + 1, U64)
            for j in range(width):
                if j not in wild:
                    key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, c * width + j].astype(U64))
            keys.append(key)
    return np.stack(keys, 1)


def _set_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name a set."""
    out = []
    for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(salt)))])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _id(docs: DataFrame):
    """(doc, anon): rows without an id are named by their text."""
    doc_id = docs["doc_id"].cast("long")
    return F.coalesce(doc_id, F.xxhash64(docs["text"].cast("string"))), doc_id.isNull()


def _texts(docs: DataFrame) -> DataFrame:
    doc, anon = _id(docs)
    return docs.select(doc.alias("doc"), anon.alias("anon"), docs["text"].cast("string").alias("text"))


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """(doc, anon, n, s1, s2, sig): a set's size, its name and its signature."""
    schema = pa.schema([("doc", pa.int64()), ("anon", pa.bool_()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(2)):
                sets, at = sorted_sets(buf, offs, size)
                s1, s2 = _set_hashes(sets, at)
                own = (batch.column(c).slice(a, b - a) for c in (0, 1))
                yield batch_of(schema, *own, np.diff(at), s1, s2, [r.tobytes() for r in signatures(sets, at)])

    return texts.mapInArrow(run, "doc long, anon boolean, n long, s1 long, s2 long, sig binary")


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, items, bits) of the wanted (doc, anon, s1, s2, node): the full set and its parity bit map."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1_want, s2_want = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b, buf, offs in slices(batch.column(0)):
                sets, at = sorted_sets(buf, offs, size)
                s1, s2 = _set_hashes(sets, at)
                rows = np.flatnonzero((s1 == s1_want[a:b]) & (s2 == s2_want[a:b]))
                items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))).take(pa.array(rows))
                maps = [parity_map(sets[at[r] : at[r + 1]]) for r in rows.tolist()]
                yield batch_of(schema, batch.column(3).slice(a, b - a).take(pa.array(rows)), np.diff(at)[rows], items, maps)

    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return texts.join(side, ["doc", "anon"]).select("text", "s1", "s2", "node").mapInArrow(run, "node long, n long, items array<long>, bits binary").dropDuplicates(["node"])


def first_shared_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first bucket that pairs of 16-bit signatures share (ERRORS is 1)."""
    differ = (x != y).reshape(*x.shape[:-1], CHUNKS, POSITIONS // CHUNKS)
    errors = differ.sum(-1)
    chunk = (errors <= ERRORS).argmax(-1)
    own = np.take_along_axis(differ, chunk[..., None, None], -2)[..., 0, :]
    return chunk * len(_WILD) + own.argmax(-1)


class Bucket:
    """Rows of whole groups: Arrow columns as arrays, and where each group begins."""

    def __init__(self, table: pa.Table):
        column = lambda k: table.column(k).to_numpy()
        self.key, self.part, self.number, self.node, self.n, self.label, self.role = map(column, range(7))
        self.sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, POSITIONS)
        self.bits = table.column(8).to_pylist() if table.num_columns > 8 else []
        new = np.ones(len(self.key), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(new)))

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): every probing row with every own row of its group that has another label, in blocks.

        ``role`` adds 1 for an own row, 2 for a probing one and 4 for a row that probes somewhere: of two such rows the
        one of the smaller node does.
        """
        probes = np.flatnonzero(self.role & 2)
        group = np.searchsorted(self.first, probes, "right") - 1
        many = self.size[group]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), AT_ONCE // 16)) if len(probes) else np.empty(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(probes)]):
            n = many[a:b]
            i = np.repeat(probes[a:b], n)
            j = np.arange(n.sum()) + np.repeat(self.first[group[a:b]] - (np.cumsum(n) - n), n)
            ok = (self.label[i] != self.label[j]) & (self.role[j] & 1 > 0)
            ok &= (self.role[j] & 4 == 0) | (self.node[i] < self.node[j])
            yield i[ok], j[ok]

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the parity bit maps of row pairs differ, the longer map folded to the shorter."""
        out = np.zeros(len(i), np.int64)
        width = np.array([len(x) for x in self.bits], np.int64)
        kinds = width[i] << 32 | width[j]
        for kind in np.unique(kinds).tolist():
            w, v = kind >> 32, kind & 0xFFFFFFFF
            least = min(w, v)
            at = np.flatnonzero(kinds == kind)
            for some in np.array_split(at, -(-len(at) * max(w, v) // (8 * AT_ONCE))):
                x, y = (self._maps(rows[some], k, least) for rows, k in ((i, w), (j, v)))
                out[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return out

    def _maps(self, rows: np.ndarray, width: int, least: int) -> np.ndarray:
        own, back = np.unique(rows, return_inverse=True)
        x = np.frombuffer(b"".join(self.bits[r] for r in own.tolist()), np.uint64).reshape(len(own), width // least, least // 8)
        return np.bitwise_xor.reduce(x, 1)[back]


def _nearest(i: np.ndarray, j: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` pairs of each i in the given order."""
    i = i[order]
    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return order[place < most]


def near_pairs(b: Bucket) -> tuple[np.ndarray, np.ndarray]:
    """The NEAREST of each row by signature, within DISTANCE, in the first bucket that a pair shares."""
    out = []
    for i, j in b.meetings():
        for a in range(0, len(i), AT_ONCE // POSITIONS):
            x, y = i[a : a + AT_ONCE // POSITIONS], j[a : a + AT_ONCE // POSITIONS]
            d = (b.sig[x] != b.sig[y]).sum(1)
            ok = np.flatnonzero(d <= DISTANCE)
            ok = ok[first_shared_key(b.sig[x[ok]], b.sig[y[ok]]) == b.number[x[ok]]]
            out.append(np.stack([x[ok], y[ok], d[ok]]))
    i, j, d = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    i, j, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
    keep = _nearest(i, j, np.lexsort((j, d, i)), NEAREST)
    return i[keep], j[keep]


def possible_pairs(b: Bucket, percent: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that neither their sizes nor their bit maps rule out, in the first bucket that a pair shares; with ``one``
    only the likeliest of each row and label."""
    out = []
    for i, j in b.meetings():
        total = b.n[i] + b.n[j]
        ok = np.abs(b.n[i] - b.n[j]) * (100 + percent) <= (100 - percent) * total
        i, j, total = i[ok], j[ok], total[ok]
        for a in range(0, len(i), AT_ONCE // POSITIONS):
            x, y, t = (v[a : a + AT_ONCE // POSITIONS] for v in (i, j, total))
            here = first_shared_key(b.sig[x], b.sig[y]) == b.number[x]
            x, y, t = x[here], y[here], t[here]
            d = b.differing(x, y)
            ok = d * (100 + percent) <= (100 - percent) * t
            out.append(np.stack([x[ok], y[ok], d[ok]]))
    i, j, d = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    if one:
        order = np.lexsort((j, d, b.label[j], i))
        keep = _nearest(i * (len(b.key) + 1) + np.unique(b.label[j], return_inverse=True)[1] if len(i) else i, j, order, 1)
        i, j = i[keep], j[keep]
    return i, j


def _candidates(rows: DataFrame, pairs_of) -> DataFrame:
    """(a, b), a the smaller set, from rows (key, part, number, node, n, label, role, sig[, bits]), group by group of (key, part)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(table: pa.Table) -> pa.RecordBatch:
        b = Bucket(table)
        i, j = pairs_of(b)
        swap = (b.n[i] > b.n[j]) | ((b.n[i] == b.n[j]) & (b.node[i] > b.node[j]))
        x, y = np.where(swap, j, i), np.where(swap, i, j)
        both = np.unique(np.stack([b.node[x], b.node[y]]), axis=1)
        return batch_of(schema, both[0], both[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that is not whole yet, and those before it
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if (key[0], part[0]) == last == (key[-1], part[-1]):
                held.append(batch)
                continue
            new = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if held or cut:
                yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, last = [batch.slice(cut)], (key[-1], part[-1])
        if held:
            yield found(pa.Table.from_batches(held))

    names = ["key", "part", "number", "node", "n", "label", "role", "sig", "bits"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the comparing tasks are bound by computing, not by rows, so small ones are not put together
    dealt = rows.select(*(c for c in names if c in rows.columns)).repartition(n, "key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets reach the similarity; the smaller set travels to the larger."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).select("a", "b")


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each reaches over the links)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        u, v = up[x], up[y]
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up[up] != up).any():
            up = up[up]
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[up]


def _forest(links: DataFrame, parts: int) -> DataFrame:
    """(node, root) of the components of each of ``parts`` random shares of the links."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches]
        if got:
            yield batch_of(schema, *contract(*np.concatenate(got, 1)))

    return links.select("a", "b").repartition(parts).mapInArrow(run, "node long, root long")


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b).

    Shares of LINKS links are contracted in tasks of their own; where there are several, labels then spread
    over the contracted links with pointer jumps until none changes.
    """
    parts = -(-links.count() // LINKS) or 1
    forest = scratch.stored(_forest(links, parts), "forest")
    if parts == 1:
        return scratch.stored(nodes.join(forest, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
    both = forest.select(F.col("node").alias("a"), F.col("root").alias("b")).union(forest.select(F.col("root").alias("a"), F.col("node").alias("b"))).where("a <> b")
    labels = scratch.stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = scratch.stored(low.join(jump, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")), "labels")
        changed = labels.where("old <> label").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels


def _apart(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, part, number, node, label, role) of the buckets that are not one component.

    Members outside a bucket's largest component probe all its members. Own rows and probing rows are
    dealt into blocks of BLOCK, and every block of the one meets every block of the other.
    """
    labelled = buckets.join(labels, "node")
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("many"))
    tops = by_label.groupBy("key").agg(F.max(F.struct("many", "label")).alias("top"), F.sum("many").alias("members"), F.count("*").alias("kinds")).where("kinds > 1")
    tops = tops.select("key", F.col("top.label").alias("top"), F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"), F.ceil((F.col("members") - F.col("top.many")) / BLOCK).cast("long").alias("probes"))
    # written first: a join of two plain exchanges lets Spark split the rows of a hot bucket
    rows = labelled.join(scratch.stored(tops, "apart"), "key").withColumns({"minor": F.col("label") != F.col("top"), "block": F.pmod(F.xxhash64("node"), "blocks"), "probe": F.pmod(F.xxhash64("node", F.lit(1)), "probes")})
    meets = """concat(
        transform(filter(sequence(0L, probes - 1), p -> not (minor and p = probe)), p -> named_struct('part', block * probes + p, 'role', if(minor, 5L, 1L))),
        if(minor, transform(sequence(0L, blocks - 1), b -> named_struct('part', b * probes + probe, 'role', if(b = block, 7L, 6L))), array()))"""
    return rows.withColumn("meet", F.explode(F.expr(meets))).select("key", F.col("meet.part").alias("part"), "number", "node", "label", F.col("meet.role").alias("role"))


def _assigned(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc, anon, n, component, kept) of every row, as a table."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = _texts(docs)
    signed = scratch.stored(_signed(texts, size), "signatures")
    # one node per distinct set, named by its smallest document; sets of ids with several and those without an id get names of their own
    several = signed.where("n > 0 and not anon").groupBy("doc").agg(F.min("s1").alias("x"), F.max("s1").alias("y"), F.min("s2").alias("z"), F.max("s2").alias("w")).where("x <> y or z <> w").select("doc", F.lit(True).alias("multi"))
    several = scratch.stored(several, "several")
    tied = several.limit(1).count() > 0
    groups = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("anon", "doc")).alias("f"), F.max("sig").alias("sig"))
    groups = groups.select("s1", "s2", "n", F.col("f.anon").alias("anon"), F.col("f.doc").alias("first"), "sig")
    groups = groups.join(several.withColumnRenamed("doc", "first"), "first", "left") if tied else groups.withColumn("multi", F.lit(False))
    groups = groups.withColumn("node", F.when(F.col("anon") | F.coalesce("multi", F.lit(False)), F.xxhash64("s1", "s2", "n")).otherwise(F.col("first")))
    groups = scratch.stored(groups.select("s1", "s2", "n", "anon", "first", "node", "sig"), "groups")
    members = signed.drop("sig").join(groups.select("s1", "s2", "n", "node"), ["s1", "s2", "n"], "left").select("doc", "anon", "n", "node")

    keyed = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = bucket_keys(sig).view(np.int64)
            at = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            yield batch_of(keyed, batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())))

    entries = groups.select("node", "sig").mapInArrow(index, "node long, keys array<long>").select("node", F.posexplode("keys").alias("number", "key"))
    full = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("members")).where("first < last")
    full = scratch.stored(full.select("key", "members"), "shared-keys")
    buckets = scratch.stored(entries.join(full, "key").select("key", F.col("number").cast("long").alias("number"), "node", "members"), "buckets")

    nodes = buckets.select("node").distinct()
    wanted = scratch.stored(groups.join(nodes, "node").select(F.col("first").alias("doc"), "anon", "s1", "s2", "node"), "wanted")
    sets = scratch.stored(_sets(texts, wanted, size), "sets")
    # nearest members first, block by block
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK).cast("long"))
    rows = buckets.join(groups.select("node", "n", "sig"), "node").withColumns({"part": block, "role": F.lit(7).cast("long"), "label": F.col("node")})
    found = scratch.stored(_confirmed(_candidates(rows, near_pairs), sets, percent), "links")
    if tied:  # documents with several sets tie these together
        several_sets = members.where("node is not null and not anon").join(several, "doc").groupBy("doc").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs"))
        extra = scratch.stored(several_sets.select("a", F.explode("bs").alias("b")).where("a <> b"), "ties")
        found = found.union(extra)
        nodes = nodes.union(extra.select("a")).union(extra.select("b")).distinct()
    labels = components(nodes, found, scratch)
    # then all that is still apart: the likeliest of each member and component, and what is left after those
    marks = sets.select("node", "n", "bits").join(groups.select("node", "sig"), "node")
    for one in (True, False):
        rows = _apart(buckets, labels, scratch).join(marks, "node")
        tried = scratch.stored(_candidates(rows, lambda b, one=one: possible_pairs(b, percent, one)), "tried")
        tries = tried.count()
        if not tries:
            break
        more = scratch.stored(_confirmed(tried, sets, percent), "links")
        linked = more.count()
        if linked:
            found = found.union(more)
            labels = components(nodes, found, scratch)
        if linked == tries:
            break
    whole = members.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    least = whole.where("part is not null").groupBy("part").agg(F.min(F.when(~F.col("anon"), F.col("doc"))).alias("least"))
    out = whole.join(scratch.stored(least, "least"), "part", "left").withColumn("component", F.when(F.col("part").isNotNull(), F.col("least")).when(~F.col("anon"), F.col("doc")))
    alone = F.col("component").isNull() & (F.col("part").isNull() | (F.col("node") == F.col("part")))
    out = stored(out.select("doc", "anon", "n", "component", F.when(F.col("anon"), alone).otherwise(F.col("doc") == F.col("component")).alias("kept")), "near-dedup")
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose ``size``-word shingle sets have a similarity of ``percent`` or more are linked.
    Words are those of the word contract, ASCII-lower-cased. Null, empty and blank texts have no
    shingles and link with nothing; texts under ``size`` words have one shingle. Rows that share an
    id are linked to whatever any of them links to. Rows without an id are a document for each
    distinct text: their doc_id is null, they link like others, a group without any id has a null component_id, and of
    such a group the rows of one set are kept. An empty table gives no rows; other columns are not read.
    """
    return _assigned(docs, percent, size).select(F.when(~F.col("anon"), F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, without those near_duplicates does not keep; nulls, ties and repeated rows as there."""
    taken = {c.lower() for c in docs.columns}
    names = [next(n for n in (f"{'_' * k}{c}" for k in range(1, len(taken) + 3)) if n not in taken) for c in ("doc", "anon")]
    gone = stored(_assigned(docs, percent, size).where("not kept").select("doc", "anon").distinct(), "near-copies").toDF(*names)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    doc, anon = _id(docs)
    return docs.join(side, (doc == F.col(names[0])) & (anon == F.col(names[1])), "left_anti")
