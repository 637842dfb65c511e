"""Toxicity: a convolutional text classifier trained in numpy.

Words and their beginnings are hashed to buckets with embeddings, which add up; filters of several widths slide over
each whole text, are max-pooled, and feed a logistic output. The decision threshold
is calibrated by language, and the language is told from the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, batch_of, distinct, mix, row_index, slices, text_words
from ._sampling import held_out, labelled
from ._shared import Scratch

#: Mean documents of a part, and the most documents and words of a pack; a part is usually one pack.
PART_DOCS, PACK_DOCS, PACK_WORDS = 3000, 4096, 1 << 22
#: Rounds after which the packs' models are averaged; the last third of them takes smaller steps.
ROUNDS = 12
#: One in so many texts sets the thresholds, the others train.
FOLDS = 5
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Bytes of a word's beginning.
PREFIX = 5
#: A bucket is used if its word stands in so many labelled documents.
LEAST_DOCS = 3
#: Share of words that a training step does not see.
DROP = 0.05
CUT = 0.7

#: Frequent words and letters that tell the languages apart.
LANGUAGES = {
    "en": ("the of and to is for that with it this are was", ""),
    "de": ("der die das und zu den ist nicht ein eine mit von auf sich des", "äöüß"),
    "fr": ("le les et des du est pour dans une qui pas sur avec", "éèêçàù"),
    "es": ("el los las y del se por con para una como su al", "ñíóáú"),
}

def _hash_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return text_words(np.frombuffer(b"".join(data), np.uint8), offs)[0]


def _language_votes() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((h, k) for k, (words, letters) in enumerate(LANGUAGES.values()) for h in _hash_of(words.split()).tolist())
    return np.array([h for h, _ in pairs], U64), np.array([k for _, k in pairs])


_VOTE_HASH, _VOTE_LANG = _language_votes()
_SECOND = np.full(1 << 16, -1, np.int8)
for _k, (_, _letters) in enumerate(LANGUAGES.values()):
    for _c in _letters + _letters.upper().replace("SS", ""):
        _SECOND[int.from_bytes(_c.encode(), "big")] = _k


def languages(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The language number of each row by votes of frequent words and letters; none: len(LANGUAGES)."""
    rows, k = len(offs) - 1, len(LANGUAGES)
    slot = np.minimum(np.searchsorted(_VOTE_HASH, words), len(_VOTE_HASH) - 1)
    hit = np.flatnonzero(_VOTE_HASH[slot] == words)
    votes = np.bincount(row_index(at)[hit] * k + _VOTE_LANG[slot[hit]], minlength=rows * k)
    lead = np.flatnonzero((buf[:-1] & 0xE0) == 0xC0) if len(buf) else np.empty(0, np.int64)
    lang = _SECOND[buf[lead].astype(np.uint16) << 8 | buf[lead + 1]] if len(lead) else np.empty(0, np.int8)
    lead, lang = lead[lang >= 0], lang[lang >= 0]
    votes = votes + np.bincount((np.searchsorted(offs, lead, "right") - 1) * k + lang, minlength=rows * k)
    votes = votes.reshape(rows, k)
    return np.where(votes.max(1) > 0, votes.argmax(1), k)


_BITS = BUCKETS.bit_length() - 1


def code_of(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash: its bucket and, above it, the hash's high bits."""
    return (words & U64(BUCKETS - 1) | words >> U64(32 + _BITS) << U64(_BITS)).astype(np.uint32)


@dataclass
class Model:
    row_of: np.ndarray  # bucket -> embedding row, 0 for words not known
    check: np.ndarray  # bucket -> the 14 high bits of its word's hash
    emb: np.ndarray
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, DIM, FILTERS)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    cut: np.ndarray | None = None  # threshold by language

    def rows(self, codes: np.ndarray) -> np.ndarray:
        bucket = codes & np.uint32(BUCKETS - 1)
        return np.where(self.check[bucket] == (codes >> np.uint32(_BITS)).astype(np.uint16), self.row_of[bucket], 0)

    def pooled(self, rows: np.ndarray, at: np.ndarray, where: bool = False):
        """Max over positions of every filter by text, and on wish the positions."""
        # two zero rows after each text keep windows apart and give empty texts one window
        pad = max(WIDTHS) - 1
        count = np.diff(at)
        starts = np.concatenate([[0], np.cumsum(count + pad)])
        padded = np.zeros((starts[-1] + pad, 2), np.int64)
        padded[np.arange(len(rows)) + pad * row_index(at)] = rows
        x = self.emb[padded[:, 0]] + self.emb[padded[:, 1]]
        n, pools, places = starts[-1], [], []
        for w in WIDTHS:
            y = x[:n] @ self.filters[w][0]
            for j in range(1, w):
                y += x[j : n + j] @ self.filters[w][j]
            top = np.maximum.reduceat(y, starts[:-1], axis=0)
            pools.append(top)
            if where:
                place = np.empty((len(count), FILTERS), np.int64)
                for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    place[r] = a + y[a:b].argmax(0)
                places.append(place)
        return (np.concatenate(pools, 1), padded, places) if where else np.concatenate(pools, 1)

    def raw(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(rows, at) + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Calibrated scores: a language's threshold stands at CUT."""
        words, at = text_words(buf, offs, PREFIX)
        p = self.raw(self.rows(code_of(words)), at)
        cut = self.cut[languages(buf, offs, words[:, 0], at)]
        return np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut))


def flat_model() -> Model:
    """Nothing to learn from: every text scores low."""
    m = Model(np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.uint16), np.zeros((1, DIM), np.float32), out_bias=-4.0, cut=np.full(len(LANGUAGES) + 1, 0.5))
    m.filters = {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
    m.bias = m.out = np.zeros(FILTERS * len(WIDTHS), np.float32)
    return m


def new_model(vocab: np.ndarray, seed: int = 7) -> Model:
    """An untrained model that knows the words of the codes ``vocab``, one of a bucket at most."""
    rng = np.random.default_rng(seed)
    bucket = vocab & np.uint32(BUCKETS - 1)
    row_of, check = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.uint16)
    row_of[bucket], check[bucket] = np.arange(1, len(vocab) + 1), (vocab >> np.uint32(_BITS)).astype(np.uint16)
    emb = rng.normal(0, 0.05, (len(vocab) + 1, DIM)).astype(np.float32)
    emb[0] = 0
    m = Model(row_of, check, emb)
    m.filters = {w: rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    k = FILTERS * len(WIDTHS)
    m.bias, m.out = np.zeros(k, np.float32), rng.normal(0, 0.3, k).astype(np.float32)
    return m


def descend(m: Model, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed) -> np.ndarray:
    """Fit ``m`` by Adam on whole texts (embedding rows of their words) for so many epochs; the embedding rows that moved."""
    rng = np.random.default_rng(seed)
    params = {"emb": m.emb, "bias": m.bias, "out": m.out, **{w: m.filters[w] for w in WIDTHS}}
    first, second = ({n: np.zeros_like(p) for n, p in params.items()} for _ in range(2))
    step, moved = 0, np.zeros(len(m.emb), bool)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            if not len(part):
                continue
            flat = np.concatenate([rows[i] for i in part])
            flat = np.where(rng.random(len(flat))[:, None] < DROP, 0, flat)
            at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in part])])
            pool, padded, places = m.pooled(flat, at, where=True)
            act = np.maximum(pool + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.out_bias, -30, 30)))
            d = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            grad = {n: np.zeros_like(q) for n, q in params.items() if n != "emb"}
            grad["out"] = act.T @ d
            back = d[:, None] * m.out * (act > 0)
            grad["bias"] = back.sum(0)
            touched, pull = [], []
            for i, w in enumerate(WIDTHS):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    e = padded[places[i] + j]  # (texts, filters, word and beginning)
                    grad[w][j] = np.einsum("rfd,rf->df", m.emb[e].sum(2), b)
                    g = (b[:, :, None] * m.filters[w][j].T[None]).reshape(-1, DIM)
                    for k in range(2):
                        touched.append(e[..., k].ravel())
                        pull.append(g)
            index, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(index), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(pull))
            g[index == 0] = 0
            step += 1
            moved[index] = True
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n, q in params.items():
                at_ = index if n == "emb" else slice(None)
                gr = g if n == "emb" else grad[n] + 1e-5 * q
                first[n][at_] = 0.9 * first[n][at_] + 0.1 * gr
                second[n][at_] = 0.999 * second[n][at_] + 0.001 * gr * gr
                q[at_] -= lr * first[n][at_] / (np.sqrt(second[n][at_]) + 1e-7)
            m.out_bias -= lr * float(d.sum())
    return moved


_GRID = np.linspace(0.05, 0.95, 91)


def _threshold(counts: np.ndarray, default: float) -> float:
    """The middle of the thresholds with the fewest errors, false alarms counting twice; counts of texts by
    label and by how many thresholds they reach."""
    if not counts.sum(1).all():
        return default
    below = counts.cumsum(1)[:, :-1]
    cost = 2 * (counts[0].sum() - below[0]) + below[1]
    best = _GRID[cost == cost.min()]
    return float(best[len(best) // 2])


#: Most bits of the filter of labelled ids; further ids let more documents pass, which the labels then rule out.
FILTER_BITS = 1 << 26


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    return tuple((mix(ids.view(U64) ^ U64(k)) & U64(bits - 1)).astype(np.int64) for k in (0x5BF03635, 0x2C1B3C6D, 0x297A2D39))


def _filter_of(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the ids (16 bits each, FILTER_BITS in all at most), as 64-bit words."""
    bits = min(max(1 << (16 * max(n, 4) - 1).bit_length(), 64), FILTER_BITS)
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = distinct(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            yield batch_of(schema, at >> 6, (U64(1) << (at & 63).astype(U64)).view(np.int64))

    got = ids.select("doc_id").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, U64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return words


def _passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.all([(words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1 for at in _places(ids, len(words) << 6)], 0)


_PACK = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("n", pa.int64()), ("n_fit", pa.int64()), ("toxic_fit", pa.int64()), *((c, pa.binary()) for c in ("y", "lang", "tune", "size", "codes"))])
_PACK_SQL = "part long, pack long, n long, n_fit long, toxic_fit long, y binary, lang binary, tune binary, size binary, codes binary"


def _packs(texts: DataFrame, rows: DataFrame, listed: np.ndarray, parts: int) -> DataFrame:
    """The texts (doc_id, text) with a label in ``rows`` (doc_id, y), in packs: labels, languages and the codes of all words.

    Texts that pass the filter ``listed`` and labels meet in the parts, sorted by id, so only codes of labelled texts
    are moved. A text's part goes by a hash of its id, whether it sets the thresholds by one of both, and its place
    in the part by both: packs do not depend on how the rows were dealt.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("tune", pa.int8()), ("y", pa.int8()), ("lang", pa.int8()), ("codes", pa.binary())])
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(shared.value, batch.column(0).to_numpy())))
            for a, b, buf, offs in slices(batch.column(3)):
                words, at = text_words(buf, offs, PREFIX)
                codes = code_of(words)
                raw = [codes[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield batch_of(schema, *(batch.column(c).slice(a, b - a) for c in range(3)), [None] * (b - a), languages(buf, offs, words[:, 0], at).astype(np.int8), raw)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, words, labelled_id, y = None, 0, [], 0, None, None

        def pack() -> pa.RecordBatch:
            ys, tune, lang, codes = zip(*held)
            ys, tune = np.array(ys, np.int8), np.array(tune, np.int8)
            size = np.array([len(c) // 8 for c in codes], np.int64)
            counts = [part, number, len(ys), (tune == 0).sum(), ys[tune == 0].sum()]
            cells = [ys, np.array(lang, np.int8), tune, size]
            return batch_of(_PACK, *([int(c)] for c in counts), *([c.tobytes()] for c in cells), [b"".join(codes)])

        for batch in batches:
            for own, doc_id, label, *text in zip(*(batch.column(c).to_pylist() for c in (6, 0, 3, 2, 4, 5))):
                if label is not None:  # an id's label comes before its texts
                    labelled_id, y = doc_id, label
                    continue
                if doc_id != labelled_id:
                    continue
                more = len(text[2]) // 8
                if held and (own != part or len(held) == PACK_DOCS or words + more > PACK_WORDS):
                    yield pack()
                    number, held, words = number + 1 if own == part else 0, [], 0
                part = own
                held.append((y, *text))
                words += more
        if held:
            yield pack()

    texts = texts.withColumn("tie", F.xxhash64("text")).select("doc_id", "tie", (F.pmod(F.xxhash64("tie", "doc_id"), F.lit(FOLDS)) == FOLDS - 1).cast("byte").alias("tune"), "text")
    found = texts.mapInArrow(hashed, "doc_id long, tie long, tune byte, y byte, lang byte, codes binary")
    marks = rows.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("tie", "long"), ("tune", "byte"))), F.col("y").cast("byte").alias("y"), F.lit(None).cast("byte").alias("lang"), F.lit(None).cast("binary").alias("codes"))
    keyed = found.union(marks).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long"))
    # labels have no tie, and nulls come first
    return keyed.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "tie").mapInArrow(packed, _PACK_SQL)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, pack, y, lang, tune, list of the texts' codes) of every pack."""
    for batch in batches:
        for r in batch.to_pylist():
            y, lang, tune = (np.frombuffer(r[c], np.int8) for c in ("y", "lang", "tune"))
            codes = np.frombuffer(r["codes"], np.uint32).reshape(-1, 2)
            yield r["part"], r["pack"], y, lang, tune == 1, np.split(codes, np.cumsum(np.frombuffer(r["size"], np.int64))[:-1])


def _known(packs: DataFrame, least: int) -> DataFrame:
    """(bucket, code): of the words that stand in ``least`` texts the commonest of each bucket, BUCKETS rows at most."""
    schema = pa.schema([("code", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, texts in _unpacked(batches):
            codes, df = np.unique(np.concatenate([distinct(t.ravel()) for t in texts]), return_counts=True)
            yield batch_of(schema, codes.astype(np.int64), df)

    counts = packs.mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    best = counts.groupBy(F.col("code").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.max(F.struct("df", "code")).alias("best"))
    return best.select("bucket", F.col("best.code").alias("code"))


#: A pack's moves of parameters travel as half floats, all multiples of 1 / _UNIT, and are added as whole numbers,
#: so that the order of packs does not matter.
_UNIT = 1 << 24
#: Embedding rows of a block; block -1 holds the other parameters.
_BLOCK = 4096


def _others(m: Model) -> np.ndarray:
    return np.concatenate([m.bias, m.out, *(m.filters[w].ravel() for w in WIDTHS), [m.out_bias]]).astype(np.float64)


def _set_others(m: Model, flat: np.ndarray) -> None:
    k = FILTERS * len(WIDTHS)
    m.bias, m.out, at = flat[:k].astype(np.float32), flat[k : 2 * k].astype(np.float32), 2 * k
    for w in WIDTHS:
        m.filters[w] = flat[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS).astype(np.float32)
        at += w * DIM * FILTERS
    m.out_bias = float(flat[at])


def _moves(packs: DataFrame, m: Model, share: float, tuned: bool, epochs: int, rate: float, number: int) -> pa.Table:
    """(block, rows, weights, moves): how far the packs' models, trained from ``m`` on, moved from it, summed with
    the packs' numbers of texts as weights; of embeddings only the rows that moved."""
    shared = packs.sparkSession.sparkContext.broadcast(m)
    moved = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("rows", pa.binary()), ("moves", pa.binary())])
    schema = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("moves", pa.binary())])
    weight_of = np.array([0.5 / (1 - share), 0.5 / share])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = shared.value, _others(shared.value)
        for part, pack, y, _, tune, texts in _unpacked(batches):
            fit_rows = np.flatnonzero(~tune) if tuned else np.arange(len(y))
            n = len(fit_rows)
            if not n:
                continue
            own = Model(start.row_of, start.check, start.emb.copy(), {w: f.copy() for w, f in start.filters.items()}, start.bias.copy(), start.out.copy(), start.out_bias)
            at = np.flatnonzero(descend(own, [own.rows(texts[i]) for i in fit_rows], y[fit_rows].astype(np.float32), weight_of[y[fit_rows]], epochs, rate, (7, number, part, pack)))
            emb, groups = (own.emb[at] - start.emb[at]).astype(np.float16), np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // _BLOCK)) + 1)
            groups = [g for g in groups if len(g)]
            ids = [int(at[g[0]]) // _BLOCK for g in groups]
            yield batch_of(moved, [*ids, -1], [n] * (len(ids) + 1), [*((at[g] % _BLOCK).astype(np.uint16).tobytes() for g in groups), bytes(2)], [*(emb[g].tobytes() for g in groups), (_others(own) - before).astype(np.float16).tobytes()])

    def added(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        weight, total = np.zeros(_BLOCK, np.int64), 0
        for n, rows, moves in zip(*(table.column(c).to_pylist() for c in ("n", "rows", "moves"))):
            at = np.frombuffer(rows, np.uint16)
            moves = np.frombuffer(moves, np.float16).reshape(len(at), -1)
            total = np.zeros((_BLOCK, moves.shape[1]), np.int64) if isinstance(total, int) else total
            weight[at] += n
            total[at] += n * (moves.astype(np.float64) * _UNIT).astype(np.int64)
        used = np.flatnonzero(weight)
        return pa.Table.from_batches([batch_of(schema, [block], *([x.tobytes()] for x in (used + max(block, 0) * _BLOCK, weight[used], total[used])))])

    out = "block int, rows binary, weights binary, moves binary"
    got = packs.mapInArrow(run, "block int, n long, rows binary, moves binary").groupBy("block").applyInArrow(added, out).toArrow()
    shared.destroy()
    return got


def _step(m: Model, moves: pa.Table) -> None:
    """Move ``m`` to the mean of the packs' models; an embedding row to the mean of those that moved it."""
    for r in moves.to_pylist():
        weight = np.frombuffer(r["weights"], np.int64)
        mean = np.frombuffer(r["moves"], np.int64).reshape(len(weight), -1) / weight[:, None] / _UNIT
        if r["block"] < 0:
            _set_others(m, _others(m) + mean[0])
        else:
            m.emb[np.frombuffer(r["rows"], np.int64)] += mean.astype(np.float32)


def _cuts(packs: DataFrame, m: Model) -> np.ndarray:
    """The thresholds by language, from counts over all texts that did not train; a language of under 40 takes the whole's."""
    kinds, places = len(LANGUAGES) + 1, len(_GRID) + 1
    shared = packs.sparkSession.sparkContext.broadcast(m)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, y, lang, tune, texts in _unpacked(batches):
            for at in np.array_split(np.flatnonzero(tune), -(-int(tune.sum()) // 32)) if tune.any() else ():
                own = [shared.value.rows(texts[i]) for i in at]
                p = shared.value.raw(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
                cells, n = np.unique((lang[at].astype(np.int64) * 2 + y[at]) * places + np.searchsorted(_GRID, p, "right"), return_counts=True)
                yield batch_of(schema, cells, n)

    got = packs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    counts = np.zeros(kinds * 2 * places, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(kinds, 2, places)
    whole = _threshold(counts.sum(0), 0.5)
    return np.array([_threshold(c, whole) if c.sum() >= 40 else whole for c in counts])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all labelled documents that are not held out; a fifth of them sets the thresholds by language.

    The documents are dealt by hash into packs of at most PACK_DOCS texts and PACK_WORDS words (a longer text is a
    pack of its own). In each round every pack trains the common model on its texts, on executors, and
    the models' mean is the next common one; words, labels and the texts that reach each threshold are counted on executors
    too. Only the words of the buckets and the model reach the driver, both bounded by BUCKETS. Several
    rows of a document all count. Null ids and null labels are not learned from; null texts count as empty;
    without rows every text scores low.
    """
    rows = labelled(docs, labels, "toxic").where("y IN (0, 1)")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = rows.count()
    packs = scratch.stored(_packs(texts, rows, _filter_of(rows, known), max(1, -(-known // PART_DOCS))), "packs")
    n, n_fit, toxic, count = packs.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_fit", "toxic_fit")), F.count("*")).first()
    if not n:
        scratch.drop()
        return flat_model()
    tuned = n >= 50
    if not tuned:  # too few texts to set some apart
        toxic, n_fit = int(sum(np.frombuffer(r.y, np.int8).sum() for r in packs.select("y").collect())), n
    m = new_model(np.sort(_known(packs, LEAST_DOCS).toArrow()["code"].to_numpy()).astype(np.uint32))
    share = min(max(toxic / max(n_fit, 1), 0.02), 0.98)
    # 12 epochs and 1000 steps of 32 texts in a pack at least, 80 epochs at most
    epochs = -(-max(12, min(80, -(-32_000 * count // max(n_fit, 1)))) // ROUNDS)
    for number in range(ROUNDS):
        _step(m, _moves(packs, m, share, tuned, epochs, 0.01 if number < ROUNDS * 2 // 3 else 0.002, number))
    m.cut = _cuts(packs, m) if tuned else np.full(len(LANGUAGES) + 1, 0.5)
    scratch.drop()
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts score as a text without known words. Repeated rows repeat, an
    empty table gives no rows; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS entries and at most as many words
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1)):
                yield batch_of(schema, batch.column(0).slice(a, b - a), shared.value.score(buf, offs))

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below CUT.

    Null and empty texts score as a text without known words and stay unless the model rejects such texts. Repeated
    rows and ties are judged alike, null ids do not matter, an empty table gives no rows, and other
    columns pass through, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(place)):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(buf, offs) < CUT))

    return docs.mapInArrow(run, docs.schema)
