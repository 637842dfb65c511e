import random

import corpus_pipeline as P
from folioframe.llm import queries

rng = random.Random(3)


def prose(n):
    return " ".join("".join(rng.choice(["the", "ing", "er", "tion", "an", "re"]) for _ in range(3)) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rows, marks, item, passage = [], [], prose(40), prose(60)
    for i in range(300):
        text = prose(rng.randint(30, 60))
        if i % 5 == 0:
            text += " idiot scum"
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    near = prose(200).split()
    for i, text in ((1001, f"{prose(20)}\n{passage}\n{prose(20)}"), (1002, f"{prose(20)}\n{passage}\n{prose(20)}"), (1003, " ".join(near)), (1004, " ".join([*near[:-2], "other", "words"])), (1005, f"{prose(20)} {item} {prose(20)}"), (1006, "")):
        rows.append((i, text, "en", "s", len(text)))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(300) if i % 5} | {1001, 1002, 1003, 1006}
    assert len(clean & set(kept["toxicity"])) >= 0.97 * len(clean) and len({i for i in range(0, 300, 5)} & set(kept["toxicity"])) <= 6
    assert passage in kept["line_dedup"][1001].text and passage not in kept["line_dedup"][1002].text
    assert kept["line_dedup"][1002].n_chars == len(kept["line_dedup"][1002].text)
    assert {1003, 1004} & set(kept["near_dedup"]) == {1003}
    assert 1005 in kept["near_dedup"] and 1005 not in kept["decontaminate"]
    assert set(kept["bpe"]) == set(kept["decontaminate"])
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, d).collect()} == {i: r.ids_sha256 for i, r in kept["bpe"].items()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string, _doc int, score double, node long"


def run_on(spark, folder, rows):
    """The documents after every stage, by stage."""
    d = str(folder)
    spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "h", 1, 0.5, 7) for i, t in rows], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("scum" in (t or ""))) for i, t in rows] + [(None, 1, 1), (99_999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = docs.collect()
    return d, kept


ITEM = prose(30)


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    near, passage, long = prose(120), prose(40), "word " * 30_000 + "é" * 2000
    rows = [(i, prose(40)) for i in range(60)]
    rows += [(300, near), (300, near), (301, near + " x"), (None, near + " y"), (None, f"a\n{passage}"), (None, f"b\n{passage}"), (None, f"b\n{passage}"), (302, f"c\n{passage}"), (303, None), (304, ""), (305, " \n\t "), (None, None), (None, ""), (306, long), (307, long), (308, f"{prose(5)} {ITEM}"), (None, ITEM), (-(1 << 63), prose(50))]
    _, kept = run_on(spark, tmp_path, rows)
    count = {name: len(v) for name, v in kept.items()}
    texts = {name: [r.text for r in v] for name, v in kept.items() if name != "bpe"}
    assert count["line_dedup"] == count["toxicity"] == len(rows)
    # the passage stays in the rows of one document without an id; equal rows come out alike
    assert sum(passage in (t or "") for t in texts["line_dedup"]) in (1, 2) and (302, "c") in {(r.doc_id, r.text) for r in kept["line_dedup"]}
    ids = [r.doc_id for r in kept["near_dedup"]]
    assert ids.count(300) == 2 and 301 not in ids and (307, "") in {(r.doc_id, r.text) for r in kept["near_dedup"]} and {303, 304, 305, -(1 << 63)} <= set(ids)
    assert near + " y" not in texts["near_dedup"] and texts["near_dedup"].count(None) == 2
    assert not any(ITEM in (t or "") for t in texts["decontaminate"]) and {303, 304, 305} <= {r.doc_id for r in kept["decontaminate"]}
    assert count["bpe"] == count["decontaminate"] and all(r.n_tokens == 0 for r in kept["bpe"] if r.doc_id in (303, 304))


def test_no_documents(spark, tmp_path):
    d, kept = run_on(spark, tmp_path, [])
    assert all(not v for v in kept.values()) and P.run(spark, d).count() == 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 11))
    assert 4 <= len(P.STAGES) <= 5
