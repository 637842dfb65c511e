"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

A text is cut into pretokens by the tokenizer's fixed pattern. Every pretoken, of whatever length, is a stream
through the transducer: WINDOW bytes are read beyond the lookahead, the tokens that end ``lookahead`` bytes before
the last byte read are stable and emitted, and the machine goes on from there; at the pretoken's end the rest is
emitted. So it holds window and lookahead only. ``lookahead`` is computed from the merge list. The
pretokens of a slice run through the machine in lockstep, and its output for a pretoken is
remembered within bounds. ``Encoder`` runs the same machine over a text that arrives in pieces.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._kernels import batch_of, prefix_hash, slices, span_hash

#: Fixed value: the byte-level pretokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens remembered by a worker (a power of two), and the ids they have together; the memory is emptied when full.
CACHE_SLOTS, CACHE_IDS = 1 << 19, 1 << 22
#: Bytes that the machine decides at a time, besides the lookahead.
WINDOW = 512
#: Bytes of pretokens that run through the machine together.
LOCKSTEP = 1 << 17
#: Characters before and after a place that decide whether a pretoken begins there.
SIGHT = 4
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(pairs: list[tuple[int, int]], made: list[int], length: dict[int, int]) -> int:
    """Bytes right of a token's start after which its extent cannot change.

    need[k] bounds how far right of the seam of merge k one must see to know whether
    it is applied: the right part itself, what decides that part, and every earlier
    merge that could take the left or the right part away. Earlier merges only, so
    one pass in priority order suffices.
    """
    inner: dict[int, int] = {}  # of a token: sight needed right of its end once its bytes are there
    rival: dict[int, int] = {}  # of a left part: sight of the merges so far that begin with it
    most = 0
    for (u, v), t in zip(pairs, made):
        need = max(inner.get(u, 0), rival.get(u, 0), length[v] + max(inner.get(v, 0), rival.get(v, 0)))
        rival[u] = max(rival.get(u, 0), need)
        inner[t] = max(inner.get(t, 0), need - length[v])
        most = max(most, need + length[u])
    return most + max(length.values())


class Tokenizer:
    """A byte-level BPE model read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        to_bytes = {t: bytes(letters[c] for c in t) for t in vocab}
        self.bytes_of: dict[int, bytes] = {i: to_bytes[t] for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for t, i in vocab.items():
            if len(to_bytes[t]) == 1:
                self.byte_id[to_bytes[t][0]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        made = [vocab[a + b] for a, b in merges]
        self.lookahead = sufficient_lookahead(pairs, made, {i: len(b) for i, b in self.bytes_of.items()})
        # an open-addressed table of pair -> rank, and rank -> token
        self.made = np.array(made, np.int64)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int64)
        codes = np.array([u << 24 | v for u, v in pairs], np.int64)
        self.probes = 0
        todo, step = np.arange(len(pairs)), 0
        while len(todo):
            slot = (self._slot(codes[todo]) + step) & (1 << self.bits) - 1
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = first[free[first]]
            self.keys[slot[won]], self.rank[slot[won]] = codes[todo[won]], todo[won]
            todo, step = np.delete(todo, won), step + 1
        self.probes = step
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letter_n = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.letter_n[i] = len(b)
        self.letter_at = np.cumsum(self.letter_n) - self.letter_n
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.letter_n))), np.uint8)
        self.longest = int(self.letter_n.max())
        self._forget()

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        code = u << 24 | v
        slot = self._slot(code)
        out = np.where(self.keys[slot] == code, self.rank[slot], _NONE)
        todo = np.flatnonzero((self.keys[slot] != code) & (self.keys[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (1 << self.bits) - 1
            got = self.keys[slot[todo]]
            hit = got == code[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def encode_words(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many byte strings, laid end to end, and how many each has.

        Every word merges its best rank in step with the others.
        """
        ids = self.byte_id[data]
        word = np.repeat(np.arange(len(lens)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), _NONE)
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(ids[:-1], ids[1:]), _NONE)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(ids))))
            over = best == _NONE
            if over.any():
                done.append((word[over], ids[over].astype("<u4")))
                keep = ~over
                ids, word, rank, best = ids[keep], word[keep], rank[keep], best[keep]
            take = rank == best
            # of overlapping hits (equal halves, as in aaa) the left one wins
            for i in np.flatnonzero(take[1:] & take[:-1]).tolist():
                if take[i]:
                    take[i + 1] = False
            at = np.flatnonzero(take)
            ids[at] = self.made[best[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done:
            return np.empty(0, "<u4"), np.zeros(len(lens), np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lens))

    def transduce(self, data: np.ndarray, lens: np.ndarray, window: int = WINDOW, open_last: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
        """Token ids of many pretokens, laid end to end, how many each has, and the bytes of the last that are undecided.

        In each round every pretoken shows the machine its next ``window`` and ``lookahead`` bytes, and gives up the
        tokens that are stable. A suffix of a BPE encoding that begins at a token is the
        encoding of its bytes, so the rest starts afresh there. With ``open_last`` the last pretoken goes on
        beyond its bytes, and only its stable tokens are emitted.
        """
        window = max(window, self.longest)
        at = np.cumsum(lens) - lens
        ends, streams = at + lens, np.flatnonzero(lens)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        left = 0
        while len(streams):
            read = np.minimum(ends[streams] - at[streams], window + self.lookahead)
            ids, many = self.encode_words(gather(data, at[streams], read), read)
            own = np.repeat(np.arange(len(streams)), many)
            size = self.letter_n[ids]
            upto = np.cumsum(size)
            upto -= np.repeat((upto - size)[np.cumsum(many) - many], many)
            closed = at[streams] + read == ends[streams]
            if open_last and streams[-1] == len(lens) - 1:
                closed[-1] = False
            stable = closed[own] | (upto <= read[own] - self.lookahead)
            out.append((streams[own[stable]], ids[stable]))
            moved = np.bincount(own[stable], size[stable], len(streams)).astype(np.int64)
            at[streams] += moved
            if open_last and streams[-1] == len(lens) - 1 and at[streams[-1]] + self.lookahead + window > ends[streams[-1]] and not moved[-1]:
                left = int(ends[streams[-1]] - at[streams[-1]])
                streams = streams[:-1]
            streams = streams[at[streams] < ends[streams]]
        if not out:
            return np.empty(0, "<u4"), np.zeros(len(lens), np.int64), left
        stream, ids = (np.concatenate(x) for x in zip(*out))
        return ids[np.argsort(stream, kind="stable")], np.bincount(stream, minlength=len(lens)), left

    def encode_text(self, text: str, step: int = 1 << 16) -> bytes:
        """Little-endian ids of one text through an ``Encoder``, special tokens apart: no memory of earlier pretokens."""
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                machine, data = Encoder(self), part.encode()
                out += [machine.feed(data[k : k + step]).tobytes() for k in range(0, len(data), step)]
                out.append(machine.close().tobytes())
        return b"".join(out)

    def _forget(self) -> None:
        self.known = 0
        self.seen = np.zeros(2 * CACHE_SLOTS, np.uint64)  # word hash of each slot, 0 if free
        self.entry = np.zeros(2 * CACHE_SLOTS, np.int64)
        self.at, self.n = np.zeros(CACHE_SLOTS + 1, np.int64), np.zeros(CACHE_SLOTS, np.int64)
        self.flat = np.empty(CACHE_IDS, "<u4")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each word hash, or -1."""
        mask = np.uint64(2 * CACHE_SLOTS - 1)
        slot = h & mask
        got = self.seen[slot]
        out = np.where(got == h, self.entry[slot], -1)
        todo = np.flatnonzero((got != h) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            got = self.seen[slot[todo]]
            hit = got == h[todo]
            out[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (got != 0)]
        return out

    def _learn(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Remember the ids of new pretokens by hash; all fit."""
        e = self.known + np.arange(len(h))
        used = self.at[self.known]
        self.flat[used : used + len(ids)] = ids
        self.n[e], self.at[e + 1] = n, used + np.cumsum(n)
        self.known += len(h)
        mask, slot, todo = np.uint64(2 * CACHE_SLOTS - 1), h & np.uint64(2 * CACHE_SLOTS - 1), np.arange(len(h))
        while len(todo):
            free = todo[self.seen[slot[todo]] == 0]
            self.entry[slot[free]] = e[free]  # of several for one slot the last stays
            won = free[self.entry[slot[free]] == e[free]]
            self.seen[slot[won]] = h[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            full = self.seen[slot[todo]] != 0
            slot[todo[full]] = (slot[todo[full]] + np.uint64(1)) & mask

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a slice, end to end, and id offsets by row."""
        at = pretokens(buf, offs)
        lens = np.diff(np.append(at, len(buf)))
        h = span_hash(prefix_hash(buf), at, at + lens) | np.uint64(1)
        kinds, first, kind = np.unique(h, return_index=True, return_inverse=True)
        found = self._find(kinds)
        old, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        runs = [(old, gather(self.flat, self.at[found[old]], self.n[found[old]]), self.n[found[old]])]
        size = np.cumsum(lens[first[new]])
        for some in np.split(new, np.searchsorted(size, np.arange(LOCKSTEP, size[-1], LOCKSTEP)) if len(new) else []):
            if not len(some):
                continue
            word = first[some]
            ids, n, _ = self.transduce(gather(buf, at[word], lens[word]), lens[word])
            runs.append((some, ids, n))
            if self.known + len(some) > CACHE_SLOTS or self.at[self.known] + len(ids) > CACHE_IDS:
                self._forget()
            if len(some) <= CACHE_SLOTS and len(ids) <= CACHE_IDS:
                self._learn(kinds[some], ids, n)
        # all kinds' ids, end to end, then those of the slice's pretokens
        ids, many, begin, used = np.concatenate([r[1] for r in runs]), np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64), 0
        for some, own, n in runs:
            many[some], begin[some] = n, used + np.cumsum(n) - n
            used += len(own)
        n = many[kind]
        total = np.concatenate([[0], np.cumsum(n)])
        return gather(ids, begin[kind], n), total[np.searchsorted(at, offs)]

    def to_bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.letters, self.letter_at[ids], self.letter_n[ids])

    def encode_rows(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Little-endian ids of each row of a slice.

        Words are remembered by 64-bit hash; a row whose ids do not spell its bytes
        (a collision, or a special token's text) is encoded by the plain path.
        """
        ids, cuts = self.encode_slice(buf, offs)
        out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        raw = buf.tobytes()
        odd: set[int] = set()
        for s in self.special:
            i = raw.find(s.encode())
            while i >= 0:
                r = int(np.searchsorted(offs, i, "right")) - 1
                odd.add(r)
                i = raw.find(s.encode(), int(offs[r + 1]))
        if not np.array_equal(self.to_bytes(ids), buf):
            odd |= {r for r in range(len(out)) if self.to_bytes(ids[cuts[r] : cuts[r + 1]]).tobytes() != raw[offs[r] : offs[r + 1]]}
        for r in odd:
            out[r] = self.encode_text(raw[offs[r] : offs[r + 1]].decode())
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [x for _, _, buf, offs in slices(pa.array(texts, pa.string())) for x in self.encode_rows(buf, offs)]


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs values[start : start + len], end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x1000):
        text = "".join(chr(c) for c in range(first, first + 0x1000) if not 0xD800 <= c < 0xE000)
        for k, name in enumerate((r"\p{L}", r"\p{N}", r"\p{White_Space}"), 1):
            out[[ord(c) for c in regex.findall(name, text)]] = k
    return out


def pretokens(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte starts of the pretokens of a slice; rows are cut apart. The fixed pattern, by runs of classes."""
    n_bytes = len(buf)
    if not n_bytes:
        return np.empty(0, np.int64)
    place = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf if len(place) == n_bytes else np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = _classes()[cp]
    n = len(cp)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(place, offs)] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= row
    start = change.copy()
    space = kind == 3
    # the last white space before other text stands alone, or joins it if U+0020
    final = np.flatnonzero(space & change[1:] & ~row[1:])
    start[final] = True
    start[final[cp[final] == 0x20] + 1] = False
    # contractions: a lone apostrophe that no U+0020 precedes, and one or two letters
    mark = np.flatnonzero((cp == 0x27) & start[:n] & change[1:])
    mark = mark[(mark + 1 < n)]
    mark = mark[~row[mark + 1] & (kind[np.minimum(mark + 1, n - 1)] == 1)]
    if len(mark):
        one = cp[mark + 1]
        two = np.where((mark + 2 < n), cp[np.minimum(mark + 2, n - 1)], 0)
        two = np.where(change[np.minimum(mark + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, k in ((single, 2), (double, 3)):
            start[mark[hit] + 1] = False
            start[mark[hit] + k] = True
    return place[np.flatnonzero(start[:n])]


class Encoder:
    """The transducer over a text in pieces: ``feed`` gives the ids that are stable, ``close`` the rest.

    It holds the open pretoken's undecided bytes (window and lookahead), SIGHT characters before them that show how
    pretokens go on, and as many after them whose pretoken is not decided yet.
    """

    def __init__(self, model: Tokenizer, window: int = WINDOW):
        self.model, self.window = model, window
        self.past = b""  # decided characters that the pattern still looks back to
        self.open = b""  # bytes of the open pretoken that are not emitted
        self.next = b""  # bytes whose pretoken is open to question

    def feed(self, data: bytes) -> np.ndarray:
        text = self.next + data
        chars = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        # an unfinished character counts as one more that is not decided
        cut = int(chars[-SIGHT - 1]) if len(chars) > SIGHT + 1 else 0
        return self._advance(text, cut, False)

    def close(self) -> np.ndarray:
        return self._advance(self.next, len(self.next), True)

    def _advance(self, text: bytes, cut: int, whole: bool) -> np.ndarray:
        if not cut and not whole:
            self.next = text
            return np.empty(0, "<u4")
        back = len(self.past)
        seen = np.frombuffer(self.past + text, np.uint8)
        if not whole:  # what follows the cut is shown to the pattern up to the last whole character
            seen = seen[: back + int(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[-1])]
        starts = pretokens(seen, np.array([0, len(seen)])) - back
        # the first byte of a text begins a pretoken; later pieces begin one only where the pattern says so
        starts = starts[(starts >= 0) & (starts < cut)]
        decided = self.open + text[:cut]
        bounds = np.concatenate([[0], starts + len(self.open), [len(decided)]])
        bounds = np.unique(bounds)
        lens = np.diff(bounds)
        ids, _, left = self.model.transduce(np.frombuffer(decided, np.uint8), lens, self.window, not whole)
        self.open = decided[len(decided) - left :] if left else b""
        held = (self.past + text[:cut])[-4 * SIGHT :]
        lead = [k for k, c in enumerate(held) if c & 0xC0 != 0x80][-SIGHT:]
        self.past, self.next = held[lead[0] :] if lead else b"", text[cut:]
        return ids


class Decoder:
    """Incremental byte-to-text machine: holds at most three bytes of an open character.

    Ill-formed bytes become U+FFFD as in lossy UTF-8 decoding.
    """

    def __init__(self, model: Tokenizer):
        self.to_bytes = model.to_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(self.to_bytes(ids).tobytes())

    def close(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def decode_ids(t: Tokenizer, data: bytes, step: int = 65536) -> Iterator[str]:
    """Text pieces of little-endian ids, in constant memory."""
    machine = Decoder(t)
    for i in range(0, len(data), 4 * step):
        yield machine.feed(np.frombuffer(data, "<u4", min(step, (len(data) - i) // 4), i))
    yield machine.close()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and on wish
    ``ids`` (array<int>) and ``decoded`` (string).

    Null counts as empty: no tokens, empty decoding. Repeated rows repeat; an empty table
    gives no rows; other columns are not read. ``path`` names the vocabulary file, which
    every executor must have.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1)):
                data = t.encode_rows(buf, offs)
                shas, texts = [], []
                for d in data:
                    h, pieces = hashlib.sha256(), []
                    for piece in decode_ids(t, d):
                        h.update(piece.encode())
                        if keep_text:
                            pieces.append(piece)
                    shas.append(h.hexdigest())
                    texts.append("".join(pieces))
                cols = [batch.column(0).slice(a, b - a), [len(d) // 4 for d in data], [hashlib.sha256(d).hexdigest() for d in data], shas]
                cols += [[np.frombuffer(d, "<i4") for d in data]] * keep_ids + [texts] * keep_text
                yield batch_of(schema, *cols)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text)
