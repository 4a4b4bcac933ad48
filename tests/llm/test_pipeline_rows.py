"""The pipeline on tables of odd rows: nulls, repeats, long texts, clashing names, and no rows at all."""

from __future__ import annotations

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, piece int, toxicity double, `a.b` int, component_id long, leaks string, shard int"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def tables(spark, tmp_path, rows):
    where = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", 1, "k", 2, 0.5, 3, 4, "l", 5) for i, t in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 1 if i % 4 == 0 else 0) for i in range(100, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "Which of the quiet rivers reaches the northern harbour first? The silver one does.")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_odd_rows(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(60)
    rows = [(i, text(20) + (" vileslur" if i % 4 == 0 else "")) for i in range(100, 160)]
    rows += [(1, None), (2, ""), (3, None), (None, None), (4, base), (5, base.upper()), (5, base), (6, base.replace(" ", "  ", 1) + " more"), (7, text(20_000)), (8, "x" * 100_000), (None, text(30))]
    rows += [(9, f"{text(5)} Which of the quiet rivers reaches the northern harbour first? The silver one does. {text(5)}")]
    sf = tables(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, sf).collect()
    ids = [x["doc_id"] for x in got if x["piece"] == 0]
    assert set(COLUMNS) <= set(got[0].asDict())
    assert len(ids) == len(set(ids)) + (ids.count(None) - 1) * (ids.count(None) > 0)
    kept = set(ids)
    # of null and empty texts one stays; of the copies one; the long ones stay; the one with the item goes; toxic ones go
    assert len(kept & {1, 2, 3}) == 1 and len(kept & {4, 5, 6}) == 1 and {7, 8} <= kept and 9 not in kept
    assert not {i for i in kept if i and 100 <= i < 160 and i % 4 == 0} and {i for i in range(100, 160) if i % 4} <= kept


def test_no_rows(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, sf)
    assert set(COLUMNS) <= set(out.columns) and out.count() == 0
