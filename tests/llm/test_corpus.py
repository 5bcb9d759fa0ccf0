"""Line dedup, hard negatives and token alignment against brute force."""

import hashlib
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from radarframe.llm import hardneg, linededup, queries, tokenalign

LINES = [
    (1, "Menu of the site\nfirst body line here\n\nshort\nMenu of the site"), (2, "  MENU of the site\t\nsecond body line here\nshort"), (3, "second body line here"), (3, "second body line here"),
    (None, "second body line here\nonly without an id"), (None, "only without an id"), (4, None), (5, ""), (6, "\n\n"), (7, "Ünïcode line that repeats\nünïcode line that repeats"), (8, "Ünïcode line that repeats"),
    (9, "nine char\nnine char"), (10, "ten  chars"), (11, "TEN  CHARS\r"), (0, "x" * 60_000), (12, "X" * 60_000 + "\nafter"),
]


@pytest.fixture(scope="module")
def lined(spark):
    return spark.createDataFrame([(*r, "own", k) for k, r in enumerate(LINES)], "doc_id long, text string, cut string, pos int").repartition(3)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_equals_brute_force(lined, batches):
    rows = lined.collect()
    want = Counter((r.doc_id, n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, brute.lines_kept([(r.doc_id, r.text) for r in rows]), strict=True))
    assert Counter(tuple(r) for r in linededup.dedup_report(lined, batches).collect()) == want


def test_line_dedup_keeps_columns_and_nulls(lined):
    done = linededup.deduplicated(lined)
    assert done.columns == lined.columns
    rows = lined.collect()
    want = Counter((r.pos, r.cut, None if r.text is None else t) for r, (_, _, t) in zip(rows, brute.lines_kept([(r.doc_id, r.text) for r in rows]), strict=True))
    assert Counter((r.pos, r.cut, r.text) for r in done.collect()) == want


def test_line_dedup_of_no_rows(lined):
    assert linededup.dedup_report(lined.where("false")).count() == 0


def test_line_index_goes_on_with_its_runs(spark, tmp_path):
    """Batches added one by one, by two sessions' indexes: levels are merged, and later documents lose what earlier ones had."""
    rng = random.Random(3)
    docs = [(k, "\n".join(f"line number {rng.randrange(60)} of them" for _ in range(5))) for k in range(70)]
    want, lost = brute.lines_kept(docs), {}
    for half in (range(4), range(4, 7)):
        index = linededup.LineIndex(spark, f"file://{tmp_path}/runs")
        for b in half:
            cuts = index.add(spark.createDataFrame(docs[10 * b : 10 * b + 10], "doc_id long, text string"))
            lost |= {r["__doc"]: len(r.cut) for r in cuts.collect()}
        levels = [k for k, _, _ in index.runs()]
        assert max(Counter(levels).values()) <= index.fanout and max(levels) >= 1
        index.close()
    assert [lost.get(k, 0) for k, _ in docs] == [d for _, d, _ in want]
    held = [r for _, n, p in index.runs() for r in index._read(n, p).collect()]
    assert len(held) == len(set(held)) == len({x for _, t in docs for x in t.split("\n")})
    index.forget()


def test_a_line_of_every_document_is_dealt_by_salts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line everywhere\nown line number "), F.col("id").cast("string")).alias("text"))
    got = linededup.dedup_report(docs).agg(F.sum("n_lines"), F.sum("n_dropped")).first()
    assert tuple(got) == (6000, 2999)


def vectors(rng, n=160):
    rows = [(k, k % 3, [rng.gauss(0, 0.2) for _ in range(7)]) for k in range(n)]
    hot = [rng.gauss(0, 0.2) for _ in range(7)]
    rows += [(n + k, k % 2, hot) for k in range(60)]  # many ties
    rows += [(50, 50 % 3, rows[50][2])]  # a repeated row
    rows += [(100, 1, [0.5] * 7), (None, 1, [0.4] * 7), (None, 2, [0.3] * 7), (201, None, [0.1] * 7), (202, 1, None), (203, 1, [0.1, None] + [0.2] * 5), (204, 1, [float("nan")] * 7), (205, 2, [float("inf")] + [0.0] * 6), (206, 2, []), (250, 2, [0.9] * 3), (300, 1, [])]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(random.Random(11))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, k string").repartition(3)
    got = Counter(tuple(r) for r in hardneg.mined(df).collect())
    assert got == Counter(brute.negatives(rows)) and len(got) > 20


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "MOST_BLOCK", 5)
    monkeypatch.setattr(hardneg, "CHUNK", 2)
    rows = vectors(random.Random(12), 120)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in hardneg.mined(df, every=20, bits=2).collect()) == Counter(brute.negatives(rows, every=20))


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hardneg.mined(spark.createDataFrame([], schema)).count() == 0
    assert hardneg.mined(spark.createDataFrame([(0, 1, [1.0])], schema)).count() == 0
    assert hardneg.mined(spark.createDataFrame([(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], schema)).collect() == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_leave_few_rows(spark):
    """Lower and upper bounds enclose every score; few rows are scored exactly."""
    import numpy as np

    rng = np.random.default_rng(4)
    q = rng.normal(0, 40, (2000, 9)).astype(np.int64)
    df = spark.createDataFrame([(r.tolist(),) for r in q], "q array<bigint>")
    cells = hardneg.Cells(hardneg.cell_bounds(df))
    least, most = hardneg.looked_up(cells.tables(q[:40]), cells.of(q))
    score = q[:40] @ q.T
    assert (least <= score).all() and (score <= most).all()
    third = np.partition(least, -5, axis=1)[:, -5:-4]
    assert (most >= third).mean() < 0.2


def test_turned_labels(spark):
    df = spark.createDataFrame([(7, 9, [1.0], 1), (8, 9, [1.0], 1), (None, 3, [1.0], 1), (14, None, [1.0], 1)], "vec_id long, label int, embedding array<float>, rank int")
    assert [r.label for r in hardneg.turned(df).collect()] == [0, 9, 3, None]


ODD = [
    "<|endoftext|> and <s> are plain", "tab\tand\nlines\n\nwith  two  spaces ", "  leading", "a▁b", "▁", " ", " nbsp   x", "12345678901234567890", "你好 世界", "don't we'll I'M", "x\x1cy \x1d z", "é combining",
    "\U0001f468‍\U0001f469‍\U0001f467 family", "a\x00b", "line\r\nend\r\n", "﻿bom",
]


def test_alignment_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + k, t) for k, t in enumerate(ODD)]
    want = brute.alignment([t for _, t in rows], tokenalign.A_MODEL, tokenalign.B_MODEL)
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, groups string, at int").repartition(2)
    got = tokenalign.aligned(df, digest=False)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_alignment_in_many_buckets_and_slices(spark, monkeypatch):
    monkeypatch.setattr(tokenalign, "BUCKET_PAIRS", 50)
    monkeypatch.setattr(tokenalign, "SLICE_POSTINGS", 40)
    monkeypatch.setattr(tokenalign, "MEMO_UNITS", 20)
    monkeypatch.setattr(tokenalign, "LARGE_GROUP", 3)
    rng = random.Random(8)
    words = ["the", "alignment", "of", "xqzzjv", "tokens", "Straße", "12345", "naïve", "supercalifragilistic", "\n", "we'll"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(60)] + [(None, None), (3, "")]
    want = brute.alignment([t for _, t in rows], tokenalign.A_MODEL, tokenalign.B_MODEL)
    got = tokenalign.alignment_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (i, _), w in zip(rows, want, strict=True))


def test_alignment_of_no_rows(none):
    assert tokenalign.alignment_report(none).count() == 0


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = brute.alignment([r.text for r in rows], tokenalign.A_MODEL, tokenalign.B_MODEL)
    got = queries.op11_token_alignment(spark, sf).collect()
    assert Counter(tuple(r) for r in got) == Counter((r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want, strict=True))
