"""Operators on Spark: nulls, empty tables, repeated rows, clashing columns, brute force."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from spanloom.llm import catalog, language, mixing, normal, packing, pairs, repetition, sampling, sentences, subjects, tokenizer


def test_look_alike_pairs_brute_force(spark):
    rows = [("a", "m", 1, "AL.46", 0), ("a", "m", 1, "AL.46", 1), ("b", "m", 1, "АL.46", 0), ("c", "m", 1, "AL.4​6", 0), ("d", "m", 2, "АL.46", 0), ("e", None, 1, "AL.46", 0), ("f", "m", 1, None, 0), ("g", "m", 1, "al.46", 0), ("h", "m", 1, "", 0), ("i", "m", 1, "​", 0), ("j", "m", 1, "AL.46", 0)]
    df = spark.createDataFrame(rows, "id string, manual_id string, page int, text string, form int")
    got = {(r.first_id, r.second_id) for r in normal.look_alike_pairs(df, ["manual_id", "page"]).collect()}
    once = {r[0]: r for r in rows if r[1] and r[3] is not None}
    want = {(x, y) for x, y in combinations(sorted(once), 2) if once[x][1:3] == once[y][1:3] and once[x][3] != once[y][3] and normal.look(once[x][3]) == normal.look(once[y][3])}
    assert got == want and ("h", "i") in got
    assert normal.look_alike_pairs(df.limit(0), ["manual_id", "page"]).count() == 0


def test_tokenizer_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenizer.encode_documents(df).collect()}
    assert got == {1: [], 2: [], 3: [15496]}
    assert tokenizer.encode_documents(df.limit(0)).count() == 0


def test_repetition_rows(spark):
    df = spark.createDataFrame([("t", "1", None, 9), ("t", "2", "", 9), ("t", "3", "Check the fuse. " * 5, 9), ("t", "3", "Check the fuse. " * 5, 9)], "tbl string, record_id string, text string, share int")
    got = {r.record_id: (r.share, r.rejected) for r in repetition.repetition(df).collect()}
    assert got["1"] == (0.0, False) and got["2"] == (0.0, False) and got["3"] == (0.8, True)


def test_packing_rows(spark):
    rows = [("a", "m", "vi", "x" * 60), ("b", "m", "vi", "x" * 40), ("c", "m", "vi", "x" * 230), ("c", "m", "vi", "x" * 230), ("d", None, "vi", None), ("e", "m", None, "")]
    items = spark.createDataFrame(rows, "segment_id string, manual_id string, lang_out string, src string").withColumn("size", F.lit("clash"))
    limits = spark.createDataFrame([("small", 100), ("bad", None)], "limit_name string, capacity_chars int")
    out = packing.pack(items.drop("size"), limits).collect()
    assert {(r.segment_id, r.piece, r["size"]) for r in out} == {("a", 0, 60), ("b", 0, 40), ("c", 0, 100), ("c", 1, 100), ("c", 2, 30), ("d", 0, 0), ("e", 0, 0)}
    used = {}
    for r in out:
        k = (r.manual_id, r.lang_out, r.container_id)
        used[k] = used.get(k, 0) + r["size"]
    assert max(used.values()) <= 100 and len(used) == 6
    assert packing.pack(items.limit(0).drop("size"), limits).count() == 0


def test_bucket_report_counts_pieces(spark):
    rows = [("a", "m", "vi", "x" * 100), ("b", "m", "vi", "x" * 230), ("c", "m", "vi", "")]
    items = spark.createDataFrame(rows, "segment_id string, manual_id string, lang_out string, src string")
    limits = spark.createDataFrame([("small", 100)], "limit_name string, capacity_chars int")
    assert {(r.bound, r["items"], r.padding) for r in packing.bucket_report(items, limits).collect()} == {(0, 1, 0), (30, 1, 0), (100, 3, 0)}


def test_mixing_rows(spark):
    rows = [(i, s, 10 + i % 7) for s, lo, n in (("big", 0, 400), ("small", 1000, 60)) for i in range(lo, lo + n)] + [(9000, "unlisted", 5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("big", 50.0, 1), ("small", 50.0, 3), ("absent", 10.0, 2), (None, 5.0, 1)], "source string, weight double, max_repeats int")
    used = mixing.mix(sized, targets)
    report = {r.source: r for r in mixing.report(used, targets.filter("source IS NOT NULL")).collect()}
    assert abs(report["big"].actual_share - 50) < 0.5 and abs(report["small"].actual_share - 50) < 0.5
    assert report["small"].most_repeats <= 3 and report["big"].most_repeats <= 1 and report["absent"].documents == 0
    assert used.filter("source = 'unlisted'").count() == 0
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_mixing_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    sized = spark.range(1500).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "cast(5 + id % 90 AS int) AS tokens")
    targets = spark.createDataFrame([("a", 40.0, 1), ("b", 60.0, 1)], "source string, weight double, max_repeats int")
    report = {r.source: r.actual_share for r in mixing.report(mixing.mix(sized, targets), targets).collect()}
    assert abs(report["a"] - 40) < 0.3 and abs(report["b"] - 60) < 0.3


def test_mixing_heavy_tail(spark):
    """Two documents of a source hold a tenth of its tokens; every share still meets its target."""
    sizes = [133_306, 99_767] + [20 + i * 37 % 700 for i in range(5000)]
    rows = [(i, "a", t) for i, t in enumerate(sizes)] + [(10_000 + i, "b", 30 + i * 11 % 300) for i in range(2500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 30.0, 1), ("b", 70.0, 2)], "source string, weight double, max_repeats int")
    report = {r.source: r.actual_share for r in mixing.report(mixing.mix(sized, targets), targets).collect()}
    assert abs(report["a"] - 30) < 0.05 and abs(report["b"] - 70) < 0.05


def test_usual_ratios(spark):
    """Repeated rows count once, partitioning is of no effect, and few rows hardly move the prior."""
    rows = [("t", str(i), "x" * 40, "漢" * 20) for i in range(200)] + [("t", "k", "x" * 40, "가" * 40)] * 50
    df = spark.createDataFrame(rows, "tbl string, record_id string, prompt string, answer string")
    got = pairs.usual_ratios(df)
    assert got == pairs.usual_ratios(df.repartition(7)) and len(got) == 25
    assert got["L", "H"] == 0.5 and abs(got["L", "K"] - pairs.DENSITY["K"]) < 0.1
    assert pairs.usual_ratios(df.limit(0))["L", "L"] == 1.0


def test_round_trip(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "한국 🙂 <|endoftext|>"), (4, "a" * 30_000)], "doc_id long, text string")
    assert all(r.same for r in df.select(tokenizer.roundtrip_column(F.col("text")).alias("same")).collect())


def test_posterior_decides_subjects(spark, monkeypatch):
    """The posteriors of the latent model, and nothing beside them, decide which rows there are."""
    data = "/root/testdata/sf0.01"
    known = subjects.fit_lexicon(spark, data)
    monkeypatch.setattr(subjects, "fit_lexicon", lambda *_: known)
    rows = subjects.document_subjects(spark, data).collect()
    assert rows and all(0.25 <= r.share <= 1 and 0.5 <= r.posterior <= 1 for r in rows)
    monkeypatch.setattr(subjects, "accuracies", lambda patterns: {v: float(v[0] == 0) for v, _ in patterns})
    swapped = {(r.doc_id, r.subject) for r in subjects.document_subjects(spark, data).collect()}
    assert swapped and swapped != {(r.doc_id, r.subject) for r in rows}


def test_label_column(spark):
    labels = [None, "", " ", "und", "auto", "en", "EN", "en_GB", "English", "zh", "zh-Hans", "zh_TW", "한국어", "Deutsch", "ko-KR", "xx-YY"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [r.x for r in df.select(language.label_column(F.col("label")).alias("x")).collect()]
    assert got == [[], [], [], [], [], ["en"], ["en"], ["en"], ["en"], ["zh-CN", "zh-TW"], ["zh-CN"], ["zh-TW"], ["ko"], ["de"], ["ko"], []]


def test_sample_of_different_texts_in_strata(spark):
    rows = [(f"en {i}", "en") for i in range(900)] + [("hot", "vi")] * 2000 + [("hot", "en")] * 10 + [(f"th {i}", "th") for i in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = [(r.lang, r.text) for r in sampling.distinct_sample(df, "text", 100, "lang")]
    assert len(got) == len(set(got)) == 100 and ("vi", "hot") in got
    assert sum(g == "th" for g, _ in got) == 30 and sum(g == "en" for g, _ in got) == 69
    assert sorted(got) == sorted((r.lang, r.text) for r in sampling.distinct_sample(df.repartition(7), "text", 100, "lang"))
    assert len(sampling.distinct_sample(df, "text", 5000)) == 931 and sampling.distinct_sample(df.limit(0), "text", 9, "lang") == []


def test_headings_fill_their_sample(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(sentences, "fit", lambda texts, heads: seen.update(texts=texts, heads=heads))
    spark.createDataFrame([("One is here.",)], "src string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("One is here.",)], "text string").write.parquet(f"{tmp_path}/logical_units.parquet")
    rows = spark.range(100_000).selectExpr("'m' AS manual_id", "cast(id AS int) AS page", "'p' AS paragraph_id", "concat('Head ', id % 900) AS text", "0 AS reading_order", "'heading' AS structural_role")
    rows.write.parquet(f"{tmp_path}/fragments.parquet")
    sentences.fit_on(spark, str(tmp_path))
    assert len(set(seen["heads"])) == sentences.SAMPLE_HEADINGS and seen["texts"] == ["One is here."]


def test_sentence_rows(spark):
    model = sentences.fit(["Check the relay. Check the fuse.", "The relay is late."] * 10)
    df = spark.createDataFrame([("t", "1", None, 5), ("t", "2", "", 5), ("t", "3", "One is here.\n\nTwo is here.", 5)], "tbl string, record_id string, text string, extra int")
    got = [(r.record_id, r.start_at, r.end_at, r.extra) for r in sentences.sentence_spans(df, model).orderBy("start_at").collect()]
    assert got == [("3", 0, 12, 5), ("3", 14, 26, 5)]


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_containers", "p5_found", "p6_found", "p7_ids", "p8_selection", "p9_found"])
def test_queries_run(spark, data, name):
    df = catalog.queries()[name](spark, data)
    want = {"p1_found": ["first_id", "second_id"], "p2_found": ["tbl", "record_id", "lang"], "p3_found": ["tbl", "record_id", "start_at", "end_at"], "p5_found": ["tbl", "record_id"], "p6_found": ["tbl", "record_id", "defect"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"]}
    assert df.columns == want.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
