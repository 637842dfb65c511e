import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import bpe, decontaminate, fingerprint, html_text, line_dedup, near_dedup, quality, secret_scan, toxicity, warc
from folioframe.llm._kernels import prefix_hash, shingles, slices, span_hash, text_words, word_hashes, word_spans
from folioframe.llm._shared import stored
from folioframe.llm.queries import vocabulary

rng = random.Random(5)
SYLLABLES = "the ing er tion an re on st ea ou nd th in at".split()
DOCS = "doc_id long, text string"


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n))


def only(texts):
    return next(iter(slices(pa.array(texts, pa.string()))))[2:]


# ---- kernels ------------------------------------------------------------------------------------
def test_words_and_shingles():
    texts = ["Aa b\tc", None, "", "d", " e  f g h i j\n", "é\x0bü"]
    buf, offs = only(texts)
    starts, ends, at = word_spans(buf, offs)
    raw = buf.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(at[r], at[r + 1])] for r in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    h, at = word_hashes(buf, offs)
    assert h[0] == word_hashes(*only(["aA"]))[0][0] and h[0] != h[1]
    s, s_at = shingles(h, at, 5)
    assert np.diff(s_at).tolist() == [1, 0, 0, 1, 2, 1]
    assert s[0] == shingles(*word_hashes(*only(["aa B c"])), 5)[0][0]
    assert len(text_words(*only(["a-b c1,é"]))[0]) == 4


# ---- near duplicates ----------------------------------------------------------------------------
def exact_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rows, base = [], [prose(120).split() for _ in range(6)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "x y"), (203, "X y"), (204, "x z")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()
    want = exact_components(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward(spark, awkward):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == 11 and {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, None: None, 4: 4, 5: 5, 6: 6, 7: 6, 8: -9, -9: -9}
    kept = near_dedup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 1, 1, 3, 4, 5, 6]
    assert near_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_ids_with_several_texts_are_tied(spark):
    a, b = prose(30), prose(30)
    got = near_dedup.near_duplicates(spark.createDataFrame([(5, a), (5, b), (7, a), (3, b)], DOCS)).collect()
    assert {r.component_id for r in got} == {3}


def test_pigeonhole():
    sig = np.array([[rng.randrange(65536) for _ in range(near_dedup.POSITIONS)] for _ in range(60)], np.uint16)
    allowed = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    other = sig.copy()
    for r in other:
        for p in rng.sample(range(near_dedup.POSITIONS), allowed):
            r[p] ^= 1
    assert all(set(a) & set(b) for a, b in zip(near_dedup.bucket_keys(sig), near_dedup.bucket_keys(other)))


def bucket(sets, labels, percent, one=True):
    """Links of one bucket as the comparing task finds them, before the full sets confirm."""
    hashes = [np.array(sorted(x), np.uint64) for x in sets]
    at = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    sig = near_dedup.signatures(np.concatenate(hashes), at)
    out = set()
    for number in range(near_dedup.CHUNKS * near_dedup.POSITIONS // near_dedup.CHUNKS):
        n = len(sets)
        columns = [np.zeros(n, int), np.zeros(n, int), np.full(n, number), np.arange(n), np.array([len(h) for h in hashes]), np.array(labels), np.full(n, 7)]
        b = near_dedup.Bucket(pa.table([*map(pa.array, columns), [r.tobytes() for r in sig], [near_dedup.parity_map(h) for h in hashes]], [*"abcdefghi"]))
        out |= set(map(tuple, np.stack(near_dedup.possible_pairs(b, percent, one), 1).tolist()))
    return sig, out


def test_bit_maps_rule_out_no_link():
    """Every pair over the threshold that meets is a candidate, whatever the sizes, and few others are."""
    for n in (3, 40, 400, 30_000):
        base = [rng.getrandbits(64) for _ in range(n)]
        sets = [{base[0]} | {h for h in base if rng.random() > cut} | {rng.getrandbits(64) for _ in range(int(n * cut))} for cut in (0, 0.05, 0.08, 0.1, 0.15, 0.3, 0.6) for _ in range(2)]
        for percent in (80, 85):
            sig, got = bucket(sets, range(len(sets)), percent, one=False)
            similar = lambda x, y: 100 * len(x & y) / max(len(x | y), 1)
            keys = [set(k) for k in near_dedup.bucket_keys(sig)]
            links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j]) >= percent and keys[i] & keys[j]}
            assert links <= got and (n < 40 or all(similar(sets[i], sets[j]) >= percent - 30 for i, j in got))


def test_hot_buckets_meet_in_blocks(spark, monkeypatch):
    """Buckets of several components, dealt into many blocks, lose no link."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    base = prose(160).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i // 30):  # four families, some of whose members are near those of others
            w[k * 11 : k * 11 + 4 + i % 5] = [f"f{i // 30}k{k}x{j}" for j in range(4)]
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact_components(rows, 85)


def test_rows_without_an_id_are_documents(spark):
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(None, a), (None, f"{a} x"), (None, b), (None, b), (None, c), (4, f"{c} y"), (-(1 << 63), prose(30)), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_doc", F.lit(1))
    got = [(r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in near_dedup.near_duplicates(df, 85).collect()]
    count = collections.Counter(got)
    assert count[None, 4, False, True] == 1 and count[4, 4, True, True] == 1 and count[-(1 << 63), -(1 << 63), True, True] == 1
    assert count[None, None, True, True] == 3 and count[None, None, False, True] == 1 and count[None, None, True, False] == 2
    kept = [r.text for r in near_dedup.drop_near_duplicates(df, 85).collect()]
    assert len(kept) == 7 and kept.count(b) == 2 and c not in kept and len({a, f"{a} x"} & set(kept)) == 1


def test_contraction():
    g = np.random.default_rng(3)
    for n in (1, 5, 60):
        a, b = g.integers(0, 80, n), g.integers(0, 80, n)
        want = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(80):
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert dict(zip(*(v.tolist() for v in near_dedup.contract(a, b)))) == want


# ---- classifiers --------------------------------------------------------------------------------
def labelled(spark, label):
    rows, marks = [], []
    for i in range(420):
        bad = i % 4 == 0
        t = prose(rng.randint(20, 80)).split()
        if bad and label == "toxic":
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "Scum,", "moron"]))
        if bad and label == "quality":
            t = [w.upper() + "!!" for w in t]
        rows.append((i, " ".join(t)))
        if i % 7:
            marks.append((i, int(bad if label == "toxic" else not bad)))
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame(marks, f"doc_id long, {label} int"), dict(marks)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels, marks = labelled(spark, label)
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == 420 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_awkward(spark, awkward, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], f"doc_id long, {label} int")
    model = module.fit(awkward, labels)
    assert module.score(awkward, model).count() == 11 and module.score(awkward.limit(0), model).count() == 0
    none = module.fit(awkward.limit(0), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(awkward, none).collect())
    if module is toxicity:
        assert module.reject_toxic(awkward, none).columns == awkward.columns


def test_toxicity_learns_from_every_labelled_text(spark):
    """A word that only stands in the last of many labelled texts, by the hash of their ids, is learned too."""
    g = random.Random(5)
    ids = [r.id for r in spark.range(6400).orderBy(F.xxhash64("id"), "id").collect()]
    learn = [i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1]
    rare, held = set(learn[3000:3400]), [i for i in ids if i not in set(learn)][:60]
    mark = {i: "scum" if i in rare else "idiot" for i in learn[:3400]}
    rows = []
    for i in learn + held:
        words = [g.choice(("tree", "lake", "stone", "cloud", "river", "field")) for _ in range(8)]
        rows.append((i, " ".join([*words, mark[i] if i in mark else "scum" if i in held[:30] else "quiet"])))
    assert len(learn) > 3700
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i in mark)) for i in learn], "doc_id long, toxic int")
    model = toxicity.fit(docs.repartition(5), labels)
    got = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(docs, model).collect()}
    assert [got[i][0] for i in held] == [1] * 30 + [0] * 30
    again = toxicity.fit(docs.repartition(3).orderBy(F.desc("doc_id")), labels.repartition(2))
    assert np.array_equal(model.emb, again.emb) and np.array_equal(model.cut, again.cut)


def test_prior_estimate():
    g = np.random.default_rng(1)
    pos, neg = g.normal(2, 1, 4000), g.normal(-2, 1, 1200)
    assert abs(quality.estimate_prior(quality.histogram(pos), quality.histogram(np.concatenate([g.normal(2, 1, 2800), neg]))) - 0.7) < 0.06


# ---- fingerprints -------------------------------------------------------------------------------
def test_fingerprints_equal_brute_force(spark):
    rows = [(i * 3, "\n".join(prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))) + "é日"[: i % 3]) for i in range(60)] + [(500, None), (501, ""), (502, rows0 := "same"), (503, rows0)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for n in (1, 4, 9):
        got = {r.doc_id: r for r in fingerprint.fingerprints(df, n).collect()}
        texts = [t or "" for _, t in sorted(rows)]
        for k, i in enumerate(sorted(got)):
            t, u = texts[k], texts[(k + 1) % len(texts)]
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            want = []
            for other in (edited, u):
                a, b = (set(fingerprint.pieces(*only([x]))[0].tolist()) for x in (t, other))
                want.append(len(a & b) / len(a | b) if a | b else 1.0)
            assert (got[i].near_edited, got[i].near_next) == pytest.approx(tuple(want))
        assert got[502].fingerprint == got[503].fingerprint and got[502].near_next == 1.0
        assert len({r.fingerprint for r in got.values()}) == 62


def test_fingerprints_awkward(spark, awkward):
    assert fingerprint.fingerprints(awkward).count() == 11 and fingerprint.fingerprints(awkward.limit(0)).count() == 0
    alone = fingerprint.fingerprints(awkward.where("doc_id = 8"), 3).first()
    assert (alone.doc_id, alone.near_next) == (8, 1.0)


def test_fingerprints_of_a_hot_id(spark):
    """Rows of one id, and rows without one, are split over ranges and stay in one ring."""
    rows = [(None, prose(8)) for _ in range(40)] + [(5, prose(8)) for _ in range(60)] + [(i, prose(8)) for i in range(100, 130)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, DOCS).repartition(4), 8)
    assert got.select(F.spark_partition_id()).distinct().count() >= 6
    texts = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest(): (i, t, u) for i, t in rows for _, u in rows}
    ring = [texts[r.edited_sha256] for r in got.collect()]
    assert collections.Counter(i for i, _, _ in ring) == collections.Counter(i for i, _ in rows)
    after, seen, t = {t: u for _, t, u in ring}, [], rows[0][1]
    while t not in seen:
        seen.append(t)
        t = after[t]
    assert len(seen) == len({t for _, t in rows}) and t == rows[0][1]


def test_first_try_reads_the_returned_sketches():
    keys = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.array([0, len(keys)])
    whole, less = fingerprint.Sketches(1, fingerprint.CELLS), fingerprint.Sketches(1, fingerprint.CELLS)
    whole.add(keys, np.zeros(4, int))
    less.add(keys[:3], np.zeros(3, int))
    assert whole.minus(less).peel()[0].tolist() == [1]
    none = np.empty(0, np.uint64)  # the digests themselves are not asked for where the sketches peel
    assert fingerprint.differences(whole, less, none, np.array([0, 0]), none, np.array([0, 0])).tolist() == [1]


# ---- decontamination ----------------------------------------------------------------------------
def plain_tiles(x, y, least):
    used_x, used_y, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and i + n not in used_x and j + n not in used_y:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        out.append(best)
        used_x.update(range(best[0], best[0] + best[2]))
        used_y.update(range(best[1], best[1] + best[2]))


def test_tiling_equals_brute_force():
    for _ in range(150):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in range(2))
        seeds = [(i, j) for i in range(len(x) - 2) for j in range(len(y) - 2) if x[i : i + 3] == y[j : j + 3]]
        if seeds:
            got = decontaminate.tile(*map(np.array, zip(*seeds)), 3)
            assert got == plain_tiles(x, y, 3)


def test_leaks(spark, awkward):
    item = prose(40).split()
    whole, swapped, part = " ".join(item), " ".join(item[20:] + ["xx"] + item[:20]), " ".join(item[:15])
    rows = [(1, f"{prose(50)} {whole}, {prose(9)}"), (2, f"{prose(30)}\n{swapped}"), (3, f"{prose(30)} {part} {prose(30)}"), (4, prose(99)), (5, whole.upper())]
    bench = spark.createDataFrame([(10, whole), (11, None), (12, "tiny text"), (13, prose(30))], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    for block in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench, block_bytes=block).collect()}
        assert set(got) == {(1, 10), (2, 10), (5, 10)} and got[2, 10].n_tiles == 2
        assert [r.doc_id for r in decontaminate.remove_leaks(docs, bench, block_bytes=block).orderBy("doc_id").collect()] == [3, 4]
    assert decontaminate.find_leaks(awkward, bench).count() == 0 and decontaminate.remove_leaks(awkward, bench).count() == 11
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_in_another_case(spark):
    item = " ".join(f"{w}{k}" for k, w in enumerate("élan Äpfel straße ñandú λόγος öl ça übung żółw déjà".split() * 2))
    docs = spark.createDataFrame([(1, item.upper()), (2, f"x {item.title()} y"), (3, item.lower()), (4, prose(40)), (5, None)], DOCS)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.coverage) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()) == [4, 5]
    bad = pa.array([item.upper().encode() + b"\xff", None]).view(pa.string())
    assert decontaminate.folded(bad).to_pylist() == [decontaminate.folded(pa.array([item]))[0].as_py() + "\ufffd", None]


def test_repeated_tokens_stay_within_memory(spark):
    """Rows with more seeds than are joined at once are compared along diagonals, with the same tiles."""
    texts = ["a " * 60, "a b " * 40 + prose(10), f"{'a ' * 30}{prose(20)} {'a ' * 30}", prose(50), "", "b a " * 9 + "c " + "a b " * 12]
    items = ["a " * 40, "a b " * 20, prose(20), "b a " * 10 + "c a b a b a b", "a a"]
    bench = decontaminate.Benchmark(list(range(len(items))), items)
    words, at = text_words(*only(texts))
    want = sorted(bench.leaks(words, at))
    assert len(want) >= 4 and all(sorted(bench.leaks(words, at, at_once=n)) == want for n in (1, 40, 500, 3000))
    for _ in range(100):
        x, y = (np.array([rng.choice("ab") for _ in range(rng.randint(0, 40))]) for _ in range(2))
        assert decontaminate.tile_matches(*decontaminate.diagonal_matches(x, y, 3), 3) == plain_tiles(x.tolist(), y.tolist(), 3)
    hostile = decontaminate.Benchmark([1], ["a " * 2000])
    assert [f[1:3] for f in hostile.leaks(*text_words(*only(["a " * 20_000])))] == [(0, 1.0)]


def test_leaks_equal_brute_force(spark):
    """Whole rows: every document against every item, tile by tile."""
    items = [prose(rng.randint(6, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 20))]
        for t in rng.sample(items, rng.randint(0, 3)):
            w = t.split()
            a, b = sorted((rng.randrange(len(w)), rng.randrange(len(w))))
            parts += rng.choice([[" ".join(w)], [" ".join(w[a:] + w[:a])], [" ".join(w[a:b])], [" ".join(w[: len(w) // 2]), prose(2), " ".join(w[len(w) // 2 :])]])
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), bench).collect()}
    want = {}
    for i, t in rows:
        for k, item in enumerate(items):
            x, y = re.findall(r"\w+", t), re.findall(r"\w+", item)
            tiles = plain_tiles(x, y, decontaminate.LEAST)
            if sum(n for *_, n in tiles) >= decontaminate.COVER * len(y) - 1e-9:
                want[i, k] = (sum(n for *_, n in tiles) / len(y), len(tiles))
    assert len(want) > 15 and got == want


def test_leaks_of_items_without_an_id(spark):
    one, two = prose(20), prose(20)
    docs = spark.createDataFrame([(1, one), (2, f"a {two} b"), (3, prose(30))], DOCS)
    bench = spark.createDataFrame([(None, one), (None, two), (4, prose(20))], "item_id long, text string")
    for block in (1 << 20, 100):
        assert sorted(map(tuple, decontaminate.find_leaks(docs, bench, block_bytes=block).select("doc_id", "item_id").collect())) == [(1, None), (2, None)]
        assert [r.doc_id for r in decontaminate.remove_leaks(docs, bench, block_bytes=block).collect()] == [3]


# ---- tokenizer ----------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, awkward):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary())
    alphabet = "abcdeéñ' \n\t123!?ÀÉ日本\x1c\x85\xa0 'st're²ⅷ"
    texts = ["", "a" * 3000, " " * 2000, "ab" * 700, "<|endoftext|>x<|endoftext|>", "don't 'sfoo ''s !'ll 'x", "é" * 900, "-" * 2000 + "=", prose(3000).replace(" ", "")]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    model = bpe.tokenizer(vocabulary())
    ids = model.encode_texts(texts)
    want = reference.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [w.ids for w in want]
    assert [model.encode_text(t) for t in texts] == ids
    assert ["".join(bpe.decode_ids(model, x, 7)) for x in ids] == [reference.decode(w.ids, skip_special_tokens=False) for w in want]
    odd = np.array([t for t in range(0, 50256, 997)], "<u4")
    assert "".join(bpe.decode_ids(model, odd.tobytes())) == reference.decode(odd.tolist(), skip_special_tokens=False)
    got = bpe.encode(awkward, vocabulary(), keep_text=True).collect()
    assert len(got) == 11 and all(r.n_tokens == len(r.ids) for r in got)
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in awkward.collect())
    assert bpe.encode(awkward.limit(0), vocabulary()).count() == 0


def small_model(letters, merges, path):
    """A byte-level model with so many random merges, and their ranks."""
    name = {b: c for c, b in bpe.byte_letters().items()}
    vocab, tokens, rank = {name[b]: b for b in range(256)}, list(letters), {}
    while len(rank) < merges:
        pair = rng.choice(tokens), rng.choice(tokens)
        if len("".join(pair)) <= 24 and pair not in rank:
            rank[pair] = len(rank)
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                tokens.append("".join(pair))
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(p) for p in rank]}, "added_tokens": []}))
    return bpe.Tokenizer(str(path)), rank, tokens


def plain_bpe(text, rank):
    tokens = list(text)
    while best := min(((rank[p], p) for p in zip(tokens, tokens[1:]) if p in rank), default=None):
        out = []
        for t in tokens:
            if out and (out[-1], t) == best[1]:
                out[-1] += t
            else:
                out.append(t)
        tokens = out
    return tokens


def test_lookahead_suffices_for_random_merges(tmp_path):
    """The machine with the smallest window equals plain BPE for hostile merge lists."""
    for k in range(100):
        letters = "ab" if k % 2 else "abc"
        model, rank, tokens = small_model(letters, rng.randint(2, 14), tmp_path / "m.json")
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(8)]
        words += [rng.choice(tokens) * 50 for _ in range(4)] + ["".join(rng.choice(tokens) for _ in range(40)) for _ in range(4)]
        ids, n, left = model.transduce(np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words]), window=1)
        cuts = np.concatenate([[0], np.cumsum(n)])
        for w, a, b in zip(words, cuts[:-1], cuts[1:]):
            assert [model.bytes_of[i].decode() for i in ids[a:b].tolist()] == plain_bpe(w, rank)
        assert left == 0


def test_texts_in_pieces():
    """The same ids whatever the pieces, and bounded memory for one endless pretoken."""
    model = bpe.tokenizer(vocabulary())
    texts = ["don't 'sfoo ''s !'ll 'x", "日本" * 300 + " \n\n x", " " * 900, "a" * 2000] + ["".join(rng.choice("' \n\tsrevéla日'") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = model.encode_texts(texts)
    for step in (1, 2, 5, 300):
        assert [model.encode_text(t, step) for t in texts] == want
    machine, most, n = bpe.Encoder(model), 0, 0
    for _ in range(300):
        n += len(machine.feed(b"abcde" * 200))
        most = max(most, len(machine.open) + len(machine.next) + len(machine.past))
    assert n > 10_000 and most < 2 * (bpe.WINDOW + model.lookahead) + 100


def test_every_pretoken_runs_through_the_machine(monkeypatch):
    model, sizes = bpe.Tokenizer(vocabulary()), []
    plain = model.transduce
    monkeypatch.setattr(model, "transduce", lambda data, lens, *a: sizes.extend(lens.tolist()) or plain(data, lens, *a))
    text = prose(300)
    model.encode_texts([text, "x" * 5000])
    assert sorted(sizes) == sorted(map(len, {w for w in re.findall(" ?[a-z]+", text)} | {"x" * 5000}))


# ---- line dedup ---------------------------------------------------------------------------------
def plain_chunks(text):
    """The chunk rule spelt out: after a line whose window hashes to 0 a chunk of enough words ends."""
    m64 = (1 << 64) - 1

    def mix(x):
        for k, f in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> k) * f & m64
        return x ^ x >> 31

    lines = text.split("\n")
    raw = [t.encode() for t in lines]
    # the hash of a line stands for its bytes; the kernel's own is tested with the words
    hashes = [int(span_hash(prefix_hash(np.frombuffer(r, np.uint8)), np.array([0]), np.array([len(r)]))[0]) for r in raw]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        roll = 0
        for k in range(line_dedup.WINDOW - 1, -1, -1):
            roll = mix((roll * 0x9E3779B97F4A7C15 + (hashes[i - k] if i >= k else 0)) & m64)
        words = sum(len(re.findall(r"[^\x20\x09-\x0d]+", x)) for x in held)
        if i == len(lines) - 1 or roll % line_dedup.MEAN_LINES == 0 and words >= line_dedup.LEAST_WORDS:
            out.append(("\n".join(held), words))
            held = []
    return out


def test_line_dedup_equals_brute_force(spark):
    shared = ["\n".join(prose(rng.randint(1, 15)) for _ in range(25)) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(0, 14)) for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(90, None), (91, ""), (92, rows[0][1])]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    count = collections.Counter(c for _, t in rows for c, w in plain_chunks(t or "") if w >= line_dedup.LEAST_WORDS)
    assert sum("\n" in c for c, n in count.items() if n > 1) > 10
    seen = set()
    for i, t in rows:
        if t is None:
            assert got[i].text is None
            continue
        kept = []
        for c, w in plain_chunks(t):
            if w >= line_dedup.LEAST_WORDS and count[c] > 1:
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        assert got[i].text == "\n".join(kept)
    assert "\n".join(c for c, _ in plain_chunks(rows[3][1])) == rows[3][1]


def test_chunks_resist_shifts():
    """A line put in moves only the boundaries next to it."""
    changed = []
    for _ in range(60):
        lines = [prose(rng.randint(1, 15)) for _ in range(80)]
        at = rng.randrange(80)
        before, after = (collections.Counter(c for c, _ in plain_chunks("\n".join(x))) for x in (lines, lines[:at] + [prose(5)] + lines[at:]))
        changed.append(sum((before - after).values()))
    assert max(changed) <= 8 and np.mean(changed) < 2.5


def test_line_dedup_rows_without_an_id(spark):
    """Rows without an id, and rows that share one, are documents; equal rows come out alike."""
    line, other = prose(12), prose(14)
    rows = [(None, f"a\n{line}"), (None, f"b\n{line}"), (None, f"b\n{line}"), (7, f"{other}\nx"), (7, f"{other}\ny"), (8, f"z\n{line}\n{other}")]
    for passages in (False, True):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("_doc", F.lit(1)).withColumn("_tie", F.lit("t")), passages=passages).collect()
        assert len(got) == 6 and {"_doc", "_tie"} <= set(got[0].asDict())
        if passages:
            assert sorted(r.text for r in got if r.doc_id is None) in map(sorted, (["a", f"b\n{line}", f"b\n{line}"], [f"a\n{line}", "b", "b"]))
            assert sorted(r.text for r in got if r.doc_id == 7) in map(sorted, (["x", f"{other}\ny"], [f"{other}\nx", "y"]))
            assert [r.text for r in got if r.doc_id == 8] == ["z"]


def test_line_dedup_awkward(spark, awkward):
    got = line_dedup.dedup_lines(awkward)
    assert got.columns == [c for c in awkward.columns if c != "n_chunks_removed"] + ["n_chunks_removed", "n_chars_removed"]
    assert got.count() == 11 and got.where("doc_id = 7").first().text == "" and got.where("doc_id = 6").first().n_chunks_removed == 0
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


def test_repeated_passages_of_short_lines_go(spark):
    """Every passage of 50 words or more goes from all documents but the first, whatever the length of its lines."""
    def lines(n, mean):
        out = []
        while sum(len(x.split()) for x in out) < n:
            out.append(" ".join(f"{word()}{rng.random()}" for _ in range(rng.choice(mean))))
        return out

    passages = [lines(50, m) for m in ([1], [2], [3], [4], [5, 6, 7, 8, 9], [2, 30], [1, 2, 12])]
    rows, want = [], {}
    for i in range(60):
        before, after = lines(rng.randint(1, 30), range(1, 14)), lines(rng.randint(1, 30), range(1, 14))
        rows.append((i, "\n".join([*before, *passages[i % 7], *after])))
        want[i] = "\n".join([*before, *(passages[i % 7] if i < 7 else []), *after])
    rows += [(100, "\n".join(["la la"] * 30)), (101, "one two\n\nthree\n" + "\n".join(passages[2][5:]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), passages=True).collect()}
    assert {i: got[i].text for i in want} == want
    assert all((got[i].n_chunks_removed, got[i].n_chars_removed) == ((1, len("\n".join(passages[i % 7]))) if i >= 7 else (0, 0)) for i in want)
    assert got[100].text == "\n".join(["la la"] * 5) and got[101].text == "one two\n\nthree"


def test_passages_awkward(spark, awkward):
    got = line_dedup.dedup_lines(awkward, passages=True)
    assert got.count() == 11 and got.where("doc_id = 7").first().text == "" and got.where("doc_id = 6").first().n_chunks_removed == 0
    assert got.where("doc_id = 3").first().text is None and line_dedup.dedup_lines(awkward.limit(0), passages=True).count() == 0


def test_line_dedup_slices_of_one_line(spark):
    """A batch or slice may hold a single line, whatever boundaries its hash would choose."""
    line = prose(12)
    rows = [(i, line if i % 8 == 5 else prose(rng.randint(10, 20))) for i in range(32)] + [(40, "w" * 1_100_000), (41, "")]
    for _, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        found = line_dedup.pieces(raw, np.array([0, len(raw)]), True)
        assert [x.tolist() for x in found[:3]] == ([[0], [0], [len(raw)]] if " " in t else [[], [], []])
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), DOCS)
    for passages in (False, True):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, passages=passages).collect()}
        assert got == {i: "" if t == line and i > 5 else t for i, t in rows}


# ---- secrets ------------------------------------------------------------------------------------
def test_secrets_equal_brute_force(spark, awkward):
    texts = ["Password: 'hunter22' token=abc api-key apikey=ABCDEFGH é AKIA" + "A1" * 9 + " " + "0af" * 9, "x" * 50, "ab" * 12, 'SECRET"  :\t', None, "", "api_key = " + "z" * 6 + "; ghp_" + "a" * 36]
    texts += ["".join(rng.choice(["pass", "word", "token", "=", ":", " ", "abcdef", "12", "AKIA", "QQQQ", "é", '"', "secret", "passwd"]) for _ in range(40)) for _ in range(200)]
    got = secret_scan.digest(secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), DOCS))).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert "hub_token" in got[6].spans
    assert secret_scan.scan_secrets(awkward).count() == 11 and secret_scan.scan_secrets(awkward.limit(0)).count() == 0


def test_kept_index_gives_the_same(spark, awkward):
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["token=abcdef1", prose(4), "AKIA" + "Q7" * 9, "x-key"]) for _ in range(9))) for i in range(60)], DOCS).repartition(3)
    index = stored(secret_scan.build_index(docs), "index")
    for rules in (secret_scan.RULES, (secret_scan.Rule("late", r"x-key \w+"),)):
        assert sorted(secret_scan.search_index(index, rules).collect()) == sorted(secret_scan.scan_secrets(docs, rules=rules).collect())
    assert secret_scan.search_index(secret_scan.build_index(awkward)).count() == 11 and secret_scan.search_index(secret_scan.build_index(awkward.limit(0))).count() == 0


def test_index_equals_the_expressions():
    """Rules with letters beyond ASCII and case folding miss nothing."""
    rules = tuple(secret_scan.Rule(p, p, f) for p in ("schlüssel=[a-z]+", "secret=x", "[kK]ey:é+", "(?i:straße|kiss)", "a(?:bcd|ßx)e?", "日本語", "İstanbul", "ab{2}c|xyz$", "(?=abcd)ab", r"\bfoo\w+") for f in (0, re.ASCII, re.IGNORECASE, re.IGNORECASE | re.ASCII))
    words = "schlüssel=abc SCHLÜSSEL=abc ſecret=x SECRET=X key:é Key:ééé KEY:É \u212aey:é straße STRASSE Straße kiSS KISS abcde aßxe aßXE 日本語 istanbul İstanbul abbc xyz abcd foobar FOOBAR".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(300)] + ["", None, "ab", "日"]
    got = secret_scan.scan_texts(texts, rules)
    for t, found in zip(texts, got):
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t or "", r.flags))
        assert found == want
    assert sum(map(len, got)) > 500


def test_segments_hold_all_postings():
    texts = [prose(rng.randint(0, 6)) + rng.choice(["", "É", "Xy"]) for _ in range(40)]
    segment = secret_scan.Segment.of(*only(texts))
    want = collections.defaultdict(set)
    for i, t in enumerate(texts):
        b = t.encode().lower()
        for k in range(len(b) - 2):
            want[b[k : k + 3]].add(i)
    assert len(segment.codes) == len(want) and all(segment.postings(g.decode("latin-1")).tolist() == sorted(rows) for g, rows in want.items())
    assert segment.postings("###").tolist() == []


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True and secret_scan.trigram_query("ab|cdef") is True
    assert secret_scan.trigram_query("abcx+d") == "abc"
    assert secret_scan.trigram_query("(?:abc|xyz)") == ("or", "abc", "xyz")


# ---- pages --------------------------------------------------------------------------------------
PAGE = "page_id long, url string, html string"


def test_html(spark):
    menu = "<ul><li>home news sport weather travel money</li></ul>"
    rows = [
        (1, "http://h/1", "<nav>m</nav><article><h1>T &amp; t</h1><p>one\n two<br>three<p>&lt;four&gt; <script>x</script><!-- c --><aside>no</aside><div class='comments'><article class=comment>no</article></div>end</article><footer>f</footer>"),
        (2, "http://h/2", f"<body><div>{menu}</div><p>alpha beta gamma</p>"), (3, "http://h/3", f"<body><div>{menu}</div><p>delta</p><form>q</form>"), (4, None, None), (5, "http://h/5", ""),
    ]
    df = spark.createDataFrame(rows, PAGE)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == "T & t\none two three\n<four>\nend" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("alpha beta gamma", "delta", "", "")
    assert html_text.extract(df, group_tokens=4).count() == 5 and html_text.extract(df.limit(0)).count() == 0


def test_html_does_not_depend_on_groups(spark):
    """A run that two pages of a host share goes, whichever groups the pages are dealt to."""
    menus = [prose(8) for _ in range(20)]
    own = [" ".join(f"{word()}{i}x{k}" for k in range(12)) for i in range(40)]
    rows = [(i, f"http://h/{i}", f"<div>{menus[i // 2]}</div><p>{own[i]}</p>") for i in range(40)]
    rows += [(50, "http://h/50", f"<article>{prose(5)}</article><div>{own[0]}</div>"), (None, "http://h/n", f"<p>{own[1]}</p><p>{own[3]} end</p>"), (51, "http://k/1", f"<p>{own[2]}</p>")]
    df = spark.createDataFrame(rows, PAGE)
    texts = lambda **k: sorted((str(r.page_id), r.text) for r in html_text.extract(df, **k).collect())
    got = dict(texts(group_tokens=4))
    assert texts(group_tokens=4) == texts() == texts(group_tokens=100)
    assert [got[str(i)] for i in range(40)] == ["", "", own[2], "", *own[4:]] and got["None"] == "end" and got["51"] == own[2]


def test_html_copies_keep_their_text(spark):
    """Copies of a page do not cover each other; what other pages repeat goes from every copy."""
    menu, text, alone = prose(8), prose(30), prose(20)
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><p>{text}</p>") for i in (1, 2, 3)] + [(4, "http://h/4", f"<div>{menu}</div><p>short words</p>")]
    rows += [(i, f"http://k/{i}", f"<p>{alone}</p>") for i in (5, 6)] + [(7, "http://l/7", f"<p>{menu}</p>"), (8, "http://l/8", f"<article>{text}</article><p>{menu}</p>")]
    df = spark.createDataFrame(rows, PAGE)
    for tokens in (4, html_text.GROUP_TOKENS):
        assert {r.page_id: r.text for r in html_text.extract(df, group_tokens=tokens).collect()} == {1: text, 2: text, 3: text, 4: "short words", 5: alone, 6: alone, 7: "", 8: text}


def test_pages_equal_what_they_were_made_of(spark):
    """Whole pages of known text among boilerplate of every kind, some elements never closed."""
    import html as escapes

    def noise():
        t = prose(rng.randint(1, 9))
        return rng.choice([f"<nav><ul><li><a href='/x'>{t}</a></li></ul></nav>", f"<div class='ad banner'>{t}</div>", f"<aside><p>{t}</p></aside>", f"<form>{t}<input></form>", f"<div id=cookie-notice><p>{t}</p></div>", f"<script>if (a<b) '{t}'</script>", f"<!-- {t} <p> -->", f"<style>{t}</style>", f"<section class='comments'><div><article class=comment>{t}</article></div></section>", f"<div role=navigation>{t}</div>"])

    rows, want = [], {}
    for i in range(120):
        texts = [prose(rng.randint(1, 12)) + rng.choice(["", " & <b> \"q\"", " é日", " x < y"]) for _ in range(rng.randint(0, 7))]
        if i == 7:
            texts = [prose(9) for _ in range(8000)]
        body = ""
        for t in texts:
            e = escapes.escape(t).replace(" ", rng.choice([" ", "  ", "\n\t"]))
            body += rng.choice([f"<p>{e}", f"<p>{e}</p>", f"<h2>{e}</h2>", f"<div><p><b>{e}<br></p></div>", f"<ul><li>{e}</li></ul>", f"<blockquote><em>{e}</em></blockquote>"])
            body += rng.choice(["", noise()])
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{noise()}<article class=post>{noise()}{body}</article>{noise()}<footer>f</footer></body></html>"
        rows.append((i, f"http://h{i % 3}/{i}", page))
        want[i] = "\n".join(texts)
    rows += rows[:5]
    got = html_text.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert len(got) == 125 and [r.page_id for r in got if r.text != want[r.page_id] or r.n_chars != len(r.text)] == []


def test_repetition_alone(spark):
    """Without structure, what other pages of the host repeat goes and unique runs stay."""
    menu = prose(8)
    rows = [(i, "http://h/", f"<nav>{menu}</nav><article>unique{i} {prose(5)}</article>") for i in range(5)]
    got = html_text.extract(spark.createDataFrame(rows, PAGE), structure=False).collect()
    assert all(menu not in r.text and r.text.startswith(f"unique{r.page_id}") for r in got)


def test_repeated_runs_equal_brute_force():
    g = np.random.default_rng(0)
    for _ in range(60):
        streams = [g.integers(0, 3, g.integers(0, 30)) for _ in range(4)]
        for i, (x, got) in enumerate(zip(streams, html_text.repeated(streams, 4))):
            want = np.zeros(len(x), bool)
            for k in range(len(x) - 3):
                if any((x[k : k + 4] == y[j : j + 4]).all() for m, y in enumerate(streams) if m != i for j in range(len(y) - 3)):
                    want[k : k + 4] = True
            assert (want == got).all()


def test_warc_round_trip(spark):
    big = "é<p>" * 400_000
    rows = [(1, "u 1", "same"), (5, "u5", "same"), (3, None, "same"), (7, "u7", big), (8, "u8", None), (9, "u9", ""), (-2, "u", "x\r\n\r\nWARC/1.1"), (None, "n", "same"), (5, "u5", "same")]
    df = spark.createDataFrame(rows, PAGE)
    got = warc.round_trip(spark, df).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((t or "").encode()), digest(t), *(("revisit", to) if to else ("response", None))) for (i, _, t), to in zip(rows, [5, None, 5, None, 9, None, None, None, None])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    strict = warc.round_trip(spark, df, least_bytes=5).collect()
    assert all(r.record_type == "response" for r in strict)
    manifest = warc.write_warc(df, str(spark.conf.get("spark.checkpoint.dir")) + "/warc-test")
    chunks = warc.read_warc(manifest).where("page_id = 7").orderBy("chunk_no").collect()
    assert len(chunks) > 3 and b"".join(bytes(c.data) for c in chunks).decode() == big and [c["last"] for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert chunks[-1].digest == chunks[-1].declared == digest(big)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>", "d", 3)], PAGE + ", text string, digest int").withColumn("n_chars", F.lit(1))
    assert html_text.extract(df).first().text == "a" and warc.round_trip(spark, df).count() == 1
