"""Line dedup over content-defined chunks of lines, and over runs of lines that chunks cut.

A rolling hash over the hashes of WINDOW neighbouring lines chooses boundaries, so inserted lines move
only the boundaries next to them; a chunk closes at a boundary once it has LEAST_WORDS words. Chunks are counted
globally by hash, the bytes of those that repeat are compared, and all but the copy in the first document are
removed. A repeated passage that is shorter than a chunk, or that a chunk's ends cut, is found by its runs: the shortest
runs of lines with enough words that begin or end at each line. Whatever lines two documents share, of enough
words together, is covered by runs they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, batch_of, distinct, mix, prefix_hash, row_index, slices, span_hash, word_spans
from ._shared import stored

#: The fewest words of a chunk or run.
LEAST_WORDS = 10
#: Lines whose hashes the rolling hash covers, and its modulus: the mean of lines between boundaries.
WINDOW, MEAN_LINES = 3, 4
_LOWEST = -(1 << 63)


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, words, whether the row's last) of every line; bytes without the line's end."""
    n = len(buf)
    starts = np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1])
    rows = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, starts[len(offs) - 1 :] - 1, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:] - 1, n)
    last = np.append(rows[1:] != rows[:-1], True)
    ends[last] = offs[rows[last] + 1]
    w, _, _ = word_spans(buf, offs)
    return rows, starts, ends, np.searchsorted(w, ends) - np.searchsorted(w, starts), last


def chunks(lines: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash, words) of every chunk, by row and start; bytes without the last line's end.

    A row's last chunk ends with the row, however few its words are. ``h`` is the prefix hash of the bytes.
    """
    rows, starts, ends, words, last = lines
    line = span_hash(h, starts, ends)
    first = np.concatenate([[True], last[:-1]])
    place = np.arange(len(line)) - np.maximum.accumulate(np.where(first, np.arange(len(line)), 0)) if len(line) else line
    roll = np.zeros(len(line), U64)
    for k in range(WINDOW - 1, -1, -1):  # lines before the row's first count as 0
        before = np.concatenate([np.zeros(k, U64), line])[: len(line)]
        roll = mix(roll * U64(0x9E3779B97F4A7C15) + np.where(place >= k, before, U64(0)))
    total = np.concatenate([[0], np.cumsum(words)])
    tail, begun = [], 0
    for i in np.flatnonzero(last | (roll % U64(MEAN_LINES) == 0)).tolist():
        if last[i] or total[i + 1] - total[begun] >= LEAST_WORDS:
            tail.append(i)
            begun = i + 1
    tail = np.array(tail, np.int64)
    head = np.concatenate([[0], tail[:-1] + 1]) if len(tail) else tail
    return rows[head], starts[head], ends[tail], span_hash(h, starts[head], ends[tail]), total[tail + 1] - total[head]


def runs(lines: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash, words) of every run, by row and start; bytes without the last line's end.

    From each line with words the shortest run onwards, and up to it the shortest run before, of
    LEAST_WORDS words or more; runs overlap and begin and end at lines with words.
    """
    rows, starts, ends, words, _ = lines
    full = words > 0
    rows, starts, ends, words = rows[full], starts[full], ends[full], words[full]
    total = np.concatenate([[0], np.cumsum(words)])
    tail = np.searchsorted(total[1:], total[:-1] + LEAST_WORDS)
    head = np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1
    forward, back = np.flatnonzero(tail < len(rows)), np.flatnonzero(head >= 0)
    head, tail = np.concatenate([forward, head[back]]), np.concatenate([tail[forward], back])
    inside = rows[head] == rows[tail]
    head, tail = np.divmod(distinct(head[inside] * len(rows) + tail[inside]), max(len(rows), 1))
    return rows[head], starts[head], ends[tail], span_hash(h, starts[head], ends[tail]), total[tail + 1] - total[head]


def pieces(buf: np.ndarray, offs: np.ndarray, passages: bool) -> tuple[np.ndarray, ...]:
    """Chunks, with ``passages`` also runs, of LEAST_WORDS words or more, by row, start and end."""
    lines, h = _lines(buf, offs), prefix_hash(buf)
    found = chunks(lines, h)
    if passages:
        found = tuple(map(np.concatenate, zip(found, runs(lines, h))))
    use = np.flatnonzero(found[4] >= LEAST_WORDS)
    order = use[np.lexsort((found[2][use], found[1][use], found[0][use]))]
    row, start, end = (x[order] for x in found[:3])
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return tuple(x[order[new]] for x in found)


def _key(id_col: str, text_col: str):
    """(doc, tie): the order of documents. Rows without an id come first, and rows of one id go by their texts' hashes."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)), F.xxhash64(F.col(text_col).cast("string"))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated chunks removed from the text, and
    ``n_chunks_removed`` and ``n_chars_removed`` (replacing columns of these names).

    Of equal chunks of LEAST_WORDS words or more the first in the first document, by id, stays. With
    ``passages`` the same holds for all runs of lines of LEAST_WORDS words or more, wherever they begin: a line
    goes if it is in a chunk or run that an earlier document, or the document before it, has too; what is
    removed in one piece counts as one chunk. Blank lines at the ends of a passage stay. Null
    texts stay null, empty ones empty, and rows are never dropped. Rows without an id come before others, each distinct text a
    document of its own; rows that share an id are documents too, in the order of their texts' hashes; rows with the same
    id and text are one document and come out alike. An empty table gives no rows.
    """
    docs = docs.drop("n_chunks_removed", "n_chars_removed")
    names = docs.columns
    place, width = names.index(text_col), len(names)
    occurrence = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(2)):
                row, _, _, h, _ = pieces(buf, offs, passages)
                yield batch_of(occurrence, h.view(np.int64), *(batch.column(c).slice(a, b - a).take(pa.array(row)) for c in range(2)))

    doc_key, tie_key = _key(id_col, text_col)
    found = docs.select(doc_key.alias("doc"), tie_key.alias("tie"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "hash long, doc long, tie long")
    again = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    listed = stored(found.join(again, "hash").groupBy("doc", "tie").agg(F.collect_set("hash").alias("hashes")), "line-hashes")

    # both joins below read one exchange of the documents
    doc, tie, hashes, gone_col = (_free(n, names) for n in ("_doc", "_tie", "_hashes", "_gone"))
    keyed = docs.withColumns({doc: doc_key, tie: tie_key})
    copies = pa.schema([("hash", pa.int64()), ("md5", pa.string()), ("doc", pa.int64()), ("tie", pa.int64()), ("bytes", pa.binary())])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(width + 2).is_valid())  # documents without repeated pieces have no list
            for a, b, buf, offs in slices(batch.column(place).cast(pa.string())):
                own = batch.column(width + 2).slice(a, b - a)
                row, start, end, h, _ = pieces(buf, offs, passages)
                signed = h.view(np.int64)
                use = np.flatnonzero(np.isin(signed, own.flatten().to_numpy()))
                sets = [set(x or ()) for x in own.to_pylist()]
                use = [i for i in use.tolist() if int(signed[i]) in sets[row[i]]]
                raw, at = buf.tobytes(), pa.array(row[use], pa.int64())
                spans = [raw[start[i] : end[i]] for i in use]
                yield batch_of(copies, signed[use], list(map(_md5, spans)), *(batch.column(width + k).slice(a, b - a).take(at) for k in range(2)), spans)

    lists = listed.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("hashes").alias(hashes)).hint("shuffle_hash")
    same = stored(keyed.join(lists, [doc, tie], "left").select(*names, doc, tie, hashes).mapInArrow(copied, "hash long, md5 string, doc long, tie long, bytes binary"), "line-copies")
    # the bytes are compared here; a digest then names them, and only digests are joined
    keepers = same.groupBy("hash", "bytes").agg(F.min(F.struct("doc", "tie")).alias("keeper"), F.first("md5").alias("md5"), F.count("*").alias("n")).where("n > 1").select("hash", "md5", "keeper")
    gone = same.select("hash", "md5", "doc", "tie").distinct().join(keepers, ["hash", "md5"]).select("hash", "md5", "doc", "tie", (F.struct("doc", "tie") == F.col("keeper")).alias("first"))
    marks = gone.groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.collect_list(F.struct("hash", "md5", "first")).alias(gone_col))

    schema = docs.schema
    kept = pa.schema([("n_chunks_removed", pa.int64()), ("n_chars_removed", pa.int64())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            marked = whole.column(width + 2).is_valid()
            rest = whole.filter(pc.invert(marked))
            zero = pa.array(np.zeros(rest.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*rest.columns[:width], zero, zero], [*names, *kept.names])
            batch = whole.filter(marked)
            for a, b, buf, offs in slices(batch.column(place).cast(pa.string())):
                own = batch.slice(a, b - a)
                lists = own.column(width + 2).to_pylist()
                texts, removed, chars = own.column(place).to_pylist(), [0] * (b - a), [0] * (b - a)
                row, start, end, h, _ = pieces(buf, offs, passages)
                raw, signed, cut = buf.tobytes(), h.view(np.int64).tolist(), np.searchsorted(row, np.arange(b - a + 1))
                for r, marks_of in enumerate(lists):
                    # copies that begin here or later go; None: the first is still to come and stays
                    left = {(m["hash"], m["md5"]): None if m["first"] else 0 for m in marks_of}
                    named = {k[0] for k in left}
                    gone_spans: list[list[int]] = []
                    for i in range(cut[r], cut[r + 1]):
                        if signed[i] not in named:
                            continue
                        a_byte, e_byte = int(start[i]), int(end[i])
                        key = (signed[i], _md5(raw[a_byte:e_byte]))
                        if key not in left:
                            continue
                        if left[key] is None:
                            left[key] = e_byte
                        elif a_byte >= left[key]:
                            if gone_spans and a_byte <= gone_spans[-1][1] + passages:
                                gone_spans[-1][1] = max(gone_spans[-1][1], e_byte)
                            else:
                                gone_spans.append([a_byte, e_byte])
                    parts, at = [], int(offs[r])
                    for x, y in gone_spans:
                        if x > at:
                            parts.append(raw[at : x - 1])
                        at = y + 1
                    if at <= offs[r + 1]:
                        parts.append(raw[at : offs[r + 1]])
                    texts[r] = b"\n".join(parts).decode()
                    removed[r], chars[r] = len(gone_spans), sum(len(raw[x:y].decode()) for x, y in gone_spans)
                cols = [own.column(i) if i != place else pa.array(texts, own.schema.field(i).type) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64()), pa.array(chars, pa.int64())], [*names, *kept.names])

    joined = keyed.join(marks.hint("shuffle_hash"), [doc, tie], "left").select(*names, doc, tie, gone_col)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return joined.mapInArrow(remove, f"{out}, n_chunks_removed long, n_chars_removed long")


def _md5(data: bytes) -> str:
    return hashlib.md5(data, usedforsecurity=False).hexdigest()
