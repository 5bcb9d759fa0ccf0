"""Document operators against brute force, over odd, repeated, very long and empty inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from radarframe.llm import decontaminate, pieces, pii, quality, sharding, simhash, sketch


def test_pii_spans_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.pii_report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_sha256 == brute.pii_digest(texts[r.doc_id]), texts[r.doc_id]
        assert r.n_ip == sum(k == "ip" for k, _, _ in brute.pii_base(texts[r.doc_id]))
    assert any("iban:" in r.spans for r in got)


def test_pii_of_no_rows(none):
    assert pii.pii_report(none).count() == 0


def test_redaction_names_kinds_and_keeps_columns(docs):
    done = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert "[EMAIL]" in done[5].text and "[CARD]" in done[5].text and "a.b@c.de" not in done[5].text
    assert done[0].text is None and done[5].n_chars == len(done[5].text)


def test_ibans_end_where_their_country_says(spark):
    texts = ["bank DE89370400440532013000 BIC COBADEFF", "iban DE89 3704 0044 0532 0130 00 2024", "konto GB82 WEST 1234 5698 7654 32", "account DE89370400440532013001 no", "iban ZZ89370400440532013000"]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].count("iban:") for k in range(5)] == [1, 1, 1, 0, 0]
    assert "iban:5:27" in got[0] and "iban:5:32" in got[1]


def test_redaction_keeps_a_column_named_pii(spark):
    (r,) = pii.redact(spark.createDataFrame([(1, "a@b.co", "own")], "doc_id long, text string, pii string")).collect()
    assert r.asDict() == {"doc_id": 1, "text": "[EMAIL]", "pii": "own"}


def test_simhash_equals_brute_force(docs):
    rows = docs.collect()
    got = Counter((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r.doc_id, brute.simhash(r.text)) for r in rows)


def test_components_equal_brute_force(spark, docs):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {k: base[k % 40] ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}) for k in range(1500)}
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    from radarframe.llm import common

    roots = {r.node: r.root for r in common.components(simhash.links(df)).collect()}
    least = {}
    for k, fp in signed:
        least.setdefault(roots.get(fp, fp), k)
    want = brute.simhash_components(prints)
    assert {k: least[roots.get(fp, fp)] for k, fp in signed} == want


def test_groups_of_copies_and_near_copies(spark):
    """A third of the rows are copies, another chain of near copies; ids of components are the smallest reachable ones."""
    rows = [(k, "the very same text in every one of these rows") for k in range(3000, 4500)]
    rows += [(k, f"text number {k} about " + " ".join(f"w{k * 31 + j}" for j in range(20))) for k in range(1500)]
    rows += [(5000 + k, " ".join(f"v{j}" for j in range(400)) + f" end {k % 40}") for k in range(600)] + [(None, "the very same text in every one of these rows")]
    prints = {k: brute.simhash(t) for k, t in rows if k is not None}
    want = brute.simhash_components(prints)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [3000] and len(got) == len(rows)


def test_spread_join_equals_join(spark):
    from radarframe.llm import common

    rows = common.staged(spark.range(6000).selectExpr("case when id % 3 = 0 then 0 else id % 700 end as k", "id"), "rows")
    keyed = spark.range(0, 700, 2).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in common.spread_join(rows, keyed, ["k"], how).select("k", "id", "v").collect())
        assert got == Counter(tuple(r) for r in rows.join(keyed, ["k"], how).select("k", "id", "v").collect())


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    test_components_equal_brute_force(spark, None)


def test_dedup_keeps_one_of_each(docs, none):
    kept = simhash.deduplicated(docs).collect()
    ids = [r.doc_id for r in kept]
    assert {9, None} <= set(ids) and 10 not in ids
    assert simhash.near_duplicates(none).count() == 0


def test_dedup_keeps_one_row_of_each(spark, docs):
    a, b, c = "the first text of all these", "quite another text about rivers", "some third thing nobody has seen"
    rows = [(1, a, 1.0), (1, a, 2.0), (1, a, 2.0), (2, a, 1.0), (1, b, 1.0), (0, b, 1.0), (None, c, 1.0), (None, c, 1.0), (None, a, 1.0)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [(b, 0), (c, None), (a, 1)]
    whole = simhash.deduplicated(docs)
    prints = [r.fp for r in simhash.fingerprints(whole).collect()]
    assert whole.columns == docs.columns and len(prints) == len(set(prints))
    assert sorted(r.score for r in whole.where("doc_id = 3").collect()) in ([0.5], [1.5])


def test_sketch_and_next_document(docs, none):
    rows = sorted((r for r in docs.collect() if r.doc_id is not None and r.doc_id != 3), key=lambda r: -r.doc_id)
    unique = docs.where("doc_id is not null and doc_id <> 3")
    got = {r.doc_id: r for r in sketch.fingerprint_report(unique).collect()}
    prints = defaultdict(set)
    for k, r in enumerate(rows):
        t, n = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(t) // 2
        assert got[r.doc_id].n_chars == len(t)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        prints[t].add(got[r.doc_id].fingerprint)
        assert 0 <= got[r.doc_id].near_edited <= 1 and 0 <= got[r.doc_id].near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    assert got[10].near_next == 1.0
    assert sketch.fingerprint_report(docs).count() == docs.count()
    assert sketch.fingerprint_report(none).count() == 0


def shingles(text):
    w = brute.words(text)
    parts = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []
    return {xxhash.xxh64_intdigest(p.encode(), seed=42) & (2**63 - 1) for p in parts}


def test_fingerprints_and_likeness_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    own = {r.doc_id: shingles(r.text) for r in rows}
    got = {r.doc_id: r for r in sketch.fingerprint_report(docs).collect()}
    errors = []
    for k, r in enumerate(rows):
        kept = own[r.doc_id] if len(own[r.doc_id]) <= sketch.FEW else {h for h in own[r.doc_id] if h < 1 << (63 - sketch.FRACTION_BITS)}
        assert got[r.doc_id].fingerprint == ",".join(f"{h:x}" for h in sorted(kept))
        after = rows[(k + 1) % len(rows)]
        half = len(r.text or "") // 2
        for near, other in ((got[r.doc_id].near_next, own[after.doc_id]), (got[r.doc_id].near_edited, shingles((r.text or "")[: len(r.text or "") - half] + (after.text or "")[:half]))):
            exact = len(own[r.doc_id] & other) / len(own[r.doc_id] | other) if own[r.doc_id] | other else 1.0
            errors.append(abs(near - exact))
    errors.sort()
    print("likeness: mean error", sum(errors) / len(errors), "95th percentile", errors[len(errors) * 95 // 100], "worst", errors[-1])
    assert sum(errors) / len(errors) < 0.02 and errors[len(errors) * 95 // 100] < 0.1


def test_short_documents_are_contained_and_merge(spark):
    long = [f"w{k}" for k in range(900)]
    rows = [(2 * k + 1, " ".join(long[9 * k : 9 * k + 5 + k % 9])) for k in range(40)]
    rows += [(2 * k, " ".join(long)) for k in range(40)]
    got = {r.doc_id: r for r in sketch.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1].contained_next == 1.0 for k in range(40))
    halves = spark.createDataFrame([(" ".join(long[:9]), " ".join(long), " ".join(long[20:60]))], "a string, b string, c string")
    for name in "abc":
        halves = sketch.sketched(halves, F.col(name), f"s{name}")
    got = halves.select(sketch.merged(F.array("sa", "sb")).alias("ab"), sketch.merged(F.array("sa", "sc")).alias("ac"), "sa", "sb", "sc").first()
    assert got.ab == got.sb and not got.sb.whole and got.ac.whole and set(got.ac.hashes) == {*got.sa.hashes, *got.sc.hashes}


def test_next_across_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 2)
    df = spark.createDataFrame([(k * k, f"t{k}") for k in range(500)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in sketch.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {k * k: f"t{(k - 1) % 500}" for k in range(500)}


@pytest.mark.parametrize("copies", [0, 4000])
def test_shards_are_even_gapless_and_keep_copies(spark, copies):
    rows = [(k, f"text {k} " * (k % 40 + 1)) for k in range(3000)] + [(10_000 + k, "the same text") for k in range(copies)] + [(20_000 + k, f"twin {k % 50}") for k in range(200)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    size, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards[texts[r.doc_id]].add(r.shard)
    assert len(size) == 40 and max(size.values()) - min(size.values()) < 0.1 * sum(size.values()) / 40 + 800
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for t, v in shards.items() if t != "the same text")


@pytest.mark.parametrize("doc_id", [7, None])
def test_shards_of_repeated_rows_are_even(spark, doc_id):
    rows = [(doc_id, "one row that is there very often")] * 4000 + [(10_000 + k, f"text {k} " * 5) for k in range(1000)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 5000 and len(size) == 40 and max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 40 + 200
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_odd_rows(docs, none):
    assert sharding.shard_report(docs).count() == docs.count()
    assert sharding.shard_report(none).count() == 0


def test_leaks_copied_and_edited(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    edited = item.replace("delta", "DELTA,").replace("eta theta", "eta new theta").replace("nu xi", "nu").replace("rho", "row")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "unrelated words make up this other benchmark item entirely")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "before " * 300 + item + " after"), (2, "x y z " + edited), (3, "alpha beta gamma and nothing else"), (4, None), (5, item)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(rows, bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 1)} and found[1, 1] == 1.0 and 0.6 < found[2, 1] < 1.0
    assert {r.doc_id for r in decontaminate.decontaminated(rows, bench).collect()} == {3, 4}
    assert decontaminate.decontaminated(docs, bench).count() == docs.count()
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_leaks_with_few_words_in_a_row(spark):
    item = [f"w{k}" for k in range(15)]
    edited = [f"x{k}" if k in (3, 7, 11, 13) else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    alone = spark.createDataFrame([(1, "before and " + " ".join(edited) + " after")], "doc_id long, text string")
    assert [(r.doc_id, r.matched) for r in decontaminate.find_leaks(alone, bench).collect()] == [(1, 11)]
    # other documents hold the trigrams that the edits broke, and those that survive twice
    others = [(2 + k, " ".join(item[k : k + 3])) for k in range(13)]
    rows = spark.createDataFrame([(1, " ".join(edited)), *others], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(rows, bench).collect()} == {1}


def edited_copies(rng, items):
    """Copies with every 4th, 5th or 3rd word replaced, and with words replaced, dropped and put in at random."""
    for i, item in enumerate(items):
        for n in (3, 4, 5):
            yield i, [f"x{i}y{k}" if k % n == n - 1 else w for k, w in enumerate(item)]
        for rate in (0.1, 0.2, 0.3, 0.4):
            out = []
            for k, w in enumerate(item):
                roll = rng.random() / rate
                out += [w] if roll >= 1 else [f"x{i}y{k}"] if roll < 0.6 else [] if roll < 0.8 else [w, f"z{i}y{k}"]
            yield i, out


def test_edited_copies_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (8, 12, 15, 20, 20, 30, 40, 60, 120, 200) for _ in range(3)]
    copies = list(edited_copies(rng, items))
    texts = [[rng.choice(vocabulary) for _ in range(30)] + copy + [rng.choice(vocabulary) for _ in range(30)] for _, copy in copies]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for i, item in enumerate(items):
        for k, score in enumerate(decontaminate.best_scores([item] * len(texts), texts)):
            if decontaminate.leaked(score, decontaminate.LEAST_WORDS, len(item)):
                want[k, i] = score / (2 * len(item))
    found = [x for x in want if x in got]
    print(len(found), "of", len(want), "found")
    assert set(got) <= set(want) and len(found) >= 0.95 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in found)
    regular = [(k, i) for k, (i, _) in enumerate(copies) if k % 7 in (1, 2) and len(items[i]) >= 12]
    assert all(x in got for x in regular)


def test_scores_equal_the_alignment():
    import random

    rng = random.Random(4)
    pairs = [([rng.choice("abcdef") for _ in range(rng.randrange(1, 30))], [rng.choice("abcdef") for _ in range(rng.randrange(0, 60))]) for _ in range(300)]
    assert decontaminate.best_scores([a for a, _ in pairs], [b for _, b in pairs]) == [decontaminate.smith_waterman(a, b)[0] for a, b in pairs]


def test_leaks_of_all_items_and_documents_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    texts = {r.doc_id: r.words for r in docs.select("doc_id", decontaminate.tokens(F.coalesce("text", F.lit(""))).alias("words")).collect()}
    want = set()
    for r in bench.select("item_id", decontaminate.tokens(F.col("text")).alias("words")).collect():
        scores = decontaminate.best_scores([r.words] * len(texts), list(texts.values()))
        want |= {(k, r.item_id) for k, s in zip(texts, scores, strict=True) if decontaminate.leaked(s, decontaminate.LEAST_WORDS, len(r.words))}
    assert want and got == want


def test_blocks_of_items_lose_none(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_GRAMS", 50)
    test_long_quotes_leak_and_single_trigrams_do_not(spark)


def test_long_quotes_leak_and_single_trigrams_do_not(spark):
    item = [f"w{k}" for k in range(200)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one of the seven words in all"), (3, "only three words")], "item_id long, text string")
    texts = {1: "so " + " ".join(item[70:130]) + " it says", 2: "this is one of the other texts", 3: "one of the seven", 4: " ".join(item[70:90]), 5: "has only three words too"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, bench).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encoded(docs).collect():
        assert r.piece_ids == model.encode(r.text or ""), (r.text or "")[:50]
        assert r.decodes
    assert pieces.encoded(none).count() == 0
    assert {r.decoded for r in pieces.decoded(pieces.encoded(docs.where("doc_id = 7"))).collect()} == {r.text for r in docs.where("doc_id = 7").collect()}


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_spark_fold_equals_the_worker(spark, kind):
    table = tuple((p, i, -float(s)) for i, (p, s) in enumerate({"▁": 3, "a": 4, "b": 4.5, "c": 5, "ab": 2.1, "bc": 2, "abc": 1.7, "▁a": 3.5, "ca": 2.6, "cab": 2.5}.items()))
    own = pieces.Pieces(table, (), 99, kind)
    words = ["▁abcab", "▁cabcab", "▁aab", "▁", "▁bca", "▁xab", "▁cabxbc", "▁▁ab"]
    got = {r.word: r.ids for r in pieces.segmented(pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), own), own).collect()}
    encoder = pieces.Encoder(own, {})
    import numpy as np

    assert got == {w: np.frombuffer(encoder.word(w), "<i4").tolist() for w in words}
    if kind == "unigram":
        score = {p: s for p, _, s in table}
        low = min(score.values()) - 10

        def best(w):
            if not w:
                return 0.0
            return max(score.get(w[:k], low if k == 1 else float("-inf")) + best(w[k:]) for k in range(1, len(w) + 1))

        names = {i: p for p, i, _ in table}
        for w in words:
            assert abs(sum(score[names[i]] if i in names else low for i in got[w]) - best(w)) < 1e-9


def test_quality_tells_labels_apart(spark, docs, none):
    good = [(k, f"the river {k} ran quietly through the old town while people walked home in the evening", 1) for k in range(300)]
    bad = [(1000 + k, f"BUY!! NOW!! {k} CHEAP!! $$$ ### CLICK!! HERE!! &&& %%%", 0) for k in range(300)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    report = quality.quality_report(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).join(rows.select("doc_id", "quality"), "doc_id")
    held = report.where("held_out").collect()
    assert held and all(r.predicted == r.quality for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in report.collect())
    labels = rows.select("doc_id", "quality")
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_report(docs, labels.where("false")).where("score <> 0.5").count() == 0
    assert quality.quality_report(none, labels).count() == 0


def test_quality_of_empty_texts_and_repeated_ids(spark, monkeypatch):
    good = [(k, f"the river {k} ran quietly through the old town while people walked home in the evening", 1) for k in range(200)]
    bad = [(1000 + k, f"BUY!! NOW!! {k} CHEAP!! $$$ ### CLICK!! HERE!! &&& %%%", 0) for k in range(200)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    odd = spark.createDataFrame([(5000, ""), (5001, None), (5002, " ")], "doc_id long, text string")
    report = {r.doc_id: r for r in quality.quality_report(rows.select("doc_id", "text").unionByName(odd), rows.select("doc_id", "quality")).collect()}
    assert all(report[k].score == 0 and report[k].predicted == 0 for k in (5000, 5001))
    kept = {r.doc_id for r in quality.keep_good(rows.select("doc_id", "text").unionByName(odd), rows.select("doc_id", "quality")).collect()}
    assert kept >= set(range(200)) and not kept & {5000, 5001}
    # many rows of one labelled id: the sample stays bounded
    monkeypatch.setattr(quality, "SAMPLE", 50)
    many = rows.unionByName(spark.range(3000).selectExpr("1L as doc_id", "concat('more of the river and the town ', id) as text", "1 as quality"))
    assert quality.fit(many.select("doc_id", "text"), many.select("doc_id", "quality")).good


def test_quality_scores_equal_brute_force(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    sizes = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[name] = {r.doc_id: [len(made.compress(d[k : k + quality.CHUNK])) for d in [(r.text or "").encode()] for k in range(0, len(d), quality.CHUNK)] for r in docs.collect()}
    import math

    for r in quality.quality_report(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, g, b = len((r.text or "").encode()), sum(sizes["good"][r.doc_id]), sum(sizes["bad"][r.doc_id])
        if not n:
            assert r.score == 0
            continue
        shrunk = math.log(min(g, b) / n)
        z = sum(w * x for w, x in zip(model.weights, (1, (b - g) / (b + g), shrunk, shrunk**2), strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_model_files_say_their_kind():
    assert pieces.Pieces.read().kind == "bpe"
    assert pieces.model_type(b"\x0a\x02ab\x12\x04\x18\x01\x20\x05") == 1 and pieces.model_type(b"\x12\x02\x18\x02") == 2


def test_pipeline_of_odd_documents(spark, docs, none):
    """Null, empty, very long, repeated and near rows, a column with a clashing name, and no rows, through every stage."""
    import corpus_pipeline

    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit(0.5))
    for source in (docs.withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(labelled), none):
        kept = source
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept.columns, stage(spark, kept, "/root/testdata/sf0.001")
            assert name == "sentencepiece" or kept.columns == before
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        if source is none:
            assert kept.count() == 0
        else:
            texts = [r.text for r in kept.collect()]
            assert len(texts) == len(set(texts)) and "" not in texts and None not in texts and all("a.b@c.de" not in t for t in texts)


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in quality.quality_report(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.3").collect()}
    assert sorted(r.doc_id for r in stage["quality"](spark, docs, sf).collect()) == sorted(good)
    roots = brute.simhash_components({r.doc_id: brute.simhash(r.text) for r in docs.collect()})
    assert sorted(r.doc_id for r in stage["simhash_dedup"](spark, docs, sf).collect()) == sorted(set(roots.values()))
    leaking = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stage["decontamination"](spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()} - leaking
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in stage["pii"](spark, docs, sf).collect():
        assert not brute.pii_base(r.text) or r.text != texts[r.doc_id]


def test_pipeline_over_a_whole_small_folder(spark):
    import corpus_pipeline

    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash_dedup", "decontamination", "pii", "sentencepiece"]
    assert 0 < done.count() <= docs.count() and done.where("not decodes").count() == 0
    # one of each text went on to the last stages, and what redaction may have made equal since is no more than it touched
    assert done.count() - done.select("text").distinct().count() <= done.where("text like '%[%]%'").count()


def test_common_phrases_propose_nothing_alone(spark, monkeypatch):
    """A phrase of every document, which an item holds too, costs no alignments; copies of the item are found wherever they are, edited ones as well."""
    import random

    rng = random.Random(21)
    item = [f"w{k}" for k in range(100)] + ["at", "the", "end", "of"] + [f"w{k}" for k in range(100, 212)]
    filler = lambda n: [f"f{rng.randrange(5000)}" for _ in range(n)]
    docs = [(k, " ".join(sum((filler(9) + ["at", "the", "end", "of"] for _ in range(60)), []))) for k in range(400)]
    short = "one two three four five six seven eight"
    edited = [w if k % 4 else "changed" for k, w in enumerate(item)]
    docs += [(1000, " ".join(filler(50) + edited + filler(50))), (1001, " ".join(item)), (1002, f"as said {short} and so on")]
    docs += [(2000 + k, f"{' '.join(filler(5))} {short} again") for k in range(120)]  # an item that many documents hold
    aligned = []
    monkeypatch.setattr(decontaminate, "best_scores", lambda a, b, real=decontaminate.best_scores: aligned.append(len(a)) or real(a, b))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, short)], "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, bench).collect()}
    assert got == {(1000, 1), (1001, 1), (1002, 2)} | {(2000 + k, 2) for k in range(120)}
    seeds = decontaminate.Seeds(bench.select("item_id", decontaminate.tokens(F.col("text")).alias("item")).withColumn("hashes", decontaminate.hashed("item")).collect())
    hashed = rows.select(decontaminate.tokens(F.col("text")).alias("words")).withColumn("hashes", decontaminate.hashed("words"))
    counts, documents = decontaminate.document_counts(hashed, seeds)
    assert documents == len(docs) and sum(n >= 400 for n in counts.values()) == 3
    seeds.rare[[k for k, n in counts.items() if n > 50]] = False
    import numpy as np

    some = [r.hashes for r in hashed.collect()]
    doc, which, _, _ = decontaminate.proposed(seeds, np.concatenate([np.array(h, np.int64) for h in some]), np.array([len(h) for h in some]))
    assert len(set(doc.tolist())) == 123


def test_very_long_items_and_documents_are_aligned(spark):
    item = " ".join(f"i{k}" for k in range(6000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x " * 30_000 + " ".join(f"i{k}" for k in range(3000, 3040)) + " y" * 30_000), (2, "x y " * 1000)], "doc_id long, text string")
    assert [(r.doc_id, r.matched) for r in decontaminate.find_leaks(rows, bench).collect()] == [(1, 40)]
