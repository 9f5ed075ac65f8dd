"""Validators of translations, the hand-off, jobs and retry state: cases with known results."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import flow, integrity



@pytest.fixture(scope="module")
def judge(spark):
    def run(source, target, f):
        return spark.createDataFrame([(source, target)], "s string, t string").select(f(F.col("s"), F.col("t")).alias("x")).first().x

    return run


def judged(spark, cases, f):
    """The results of ``f`` over (source, target, ...) cases, in their order, by one job."""
    rows = [(n, c[0], c[1], c[2] if len(c) > 3 else None) for n, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, s string, t string, lang string")
    return [r.x for r in df.select("n", f(F.col("s"), F.col("t"), F.col("lang")).alias("x")).orderBy("n").collect()]


INVARIANTS = [
    ("D100 = 250", "Đặt D100 = 200", ["value association D100", "numbers"]),
    ("Pressure: 0.5 MPa", "Áp suất: 5 MPa", ["numbers", "engineering quantities"]),
    ("Length: 2350mm", "Chiều dài: 2350 mm", []),
    ("Length: 2350mm", "Chiều dài: 2530 mm", ["numbers", "engineering quantities"]),
    ("Alarm 0x2005", "Cảnh báo 0x2006", ["technical identifiers"]),
    ("Keep <b0></b0>", "Giữ nguyên", ["structural tags"]),
    ("Keep <b0></b0>", "Giữ <b0>", ["structural tags", "translation tag structure"]),
    ("Run MOV D100 D200", "Chạy BMOV D100 D200", ["executable code tokens"]),
    ("Append `;` to the protocol string.", "Thêm vào chuỗi giao thức.", ["technical syntax"]),
    ("Set axis X to 100 and D5 = 3", "Đặt trục X thành 90 và D5 = 3", ["value association axis:X", "numbers"]),
    ("10~20 값", "giá trị 10–20", []),
    ("Set 5 to D7", "Gán 5 cho D7", []),
    (None, None, []),
]
MEANINGS = [
    ("Servo ON 전 위치 확인", "Kiểm tra vị trí trước khi Servo ON.", []),
    ("Servo ON 전 위치 확인", "Kiểm tra vị trí sau khi Servo ON.", ["semantic Korean order"]),
    ("설정값 변경이 필요합니다.", "Có thể thay đổi giá trị cài đặt.", ["semantic Korean need"]),
    ("설정값 변경이 필요합니다.", "Không cần thay đổi.", ["semantic Korean need"]),
    ("설정값 변경이 필요합니다.", "Cần thay đổi.", []),
    ("대응이 필요함", "Cần người phụ trách.", ["semantic Korean unsupported responsibility"]),
    ("Do not touch the relay.", "Chạm vào rơ le.", ["semantic prohibition"]),
    ("You must not stop.", "Không dừng.", []),
    ("You must stop.", "Dừng.", ["semantic mandatory"]),
    ("D1 before D2", "D1 sau D2", ["semantic order"]),
    ("Before D2, set D1", "Đặt D1 trước D2", []),
]
CODES = [
    ("통신할 수 있습니다.", "Có thể giao tiếp.", None, []),
    ("TCP / UDP 통신 가능", "Có thể 통신 bằng TCP / UDP", None, ["hangul_leak"]),
    ("可以通信", "Có thể 通信", "zh", ["han_leak"]),
    ("Safety requirements", "Safety requirements", "en", ["unchanged_prose"]),
    ("TCP / UDP 통신 상태", "Trạng thái TCP / UDP 1 1 1 1 1 1", None, ["repeated_token_corruption"]),
    ("상태 1 1 1 1", "Trạng thái 1 1 1 1", None, []),
    ("프로토콜 상태", "Trạng thái giao thức ;;;;;;;;", None, ["repeated_char_corruption"]),
    ("구분선 ----", "Đường phân cách ----", None, []),
    ("Safety requirements", "Yêu cầu an toàn тест", "en", ["unexpected_script"]),
    ("Safety requirements apply.", "x" * 100, "en", ["length_explosion"]),
    ('"Start" 버튼', 'Nút "Start"', None, []),
    (None, None, None, []),
]


def test_invariants(spark):
    got = judged(spark, INVARIANTS, lambda s, t, _: integrity.invariant_differences(s, t))
    assert [[d.category for d in x] for x in got] == [c[-1] for c in INVARIANTS]


def test_meaning(spark):
    got = judged(spark, MEANINGS, lambda s, t, _: integrity.meaning_differences(s, t, F.lit("vi")))
    assert [[d.category for d in x] for x in got] == [c[-1] for c in MEANINGS]
    assert not any(judged(spark, MEANINGS, lambda s, t, _: integrity.meaning_differences(s, t, F.lit("de"))))


def test_integrity(spark):
    assert judged(spark, CODES, lambda s, t, lang: integrity.integrity_codes(s, t, lang, F.lit("vi"), F.lit(True))) == [c[-1] for c in CODES]
    assert not any(judged(spark, CODES, lambda s, t, lang: integrity.integrity_codes(s, t, lang, F.lit("de"), F.lit(True))))


def test_english_in_korean(judge):
    assert judge("Servo Motor 와 PLC 확인", "Kiểm tra Servo Motor", integrity.english_missing) == ["PLC"]
    assert judge("Manual 작성", "Viết", integrity.english_missing) == ["Manual"]
    assert judge("Manual only", "x", integrity.english_missing) == []


def test_first_failures(spark):
    long = "Check the relay and the fuse before use."
    cases = {
        "DuplicateTargetFragmentError": (long, "Kiểm tra rơ le và cầu chì. Kiểm tra rơ le và cầu chì."),
        "FormulaPlaceholderError": ("a <b0></b0>", "b"),
        "VerifiedProperNameError": ("by Inovance Technology", "bởi ai"),
        "TechnicalInvariantError": ("D100 = 250", "D100 = 200"),
        "TranslationIntegrityError": ("통신 상태", "Trạng thái 통신"),
        "TerminologyConsistencyError": ("Check the relay", "Kiểm tra"),
        None: ("Check the relay", "Kiểm tra rơ le"),
    }
    df = spark.createDataFrame([(str(k), *v) for k, v in cases.items()], "k string, s string, t string")
    got = {r.k: r.f for r in df.select("k", integrity.first_failure(F.col("s"), F.col("t"), F.lit("vi"), glossary={"relay": "rơ le"}).alias("f")).collect()}
    assert got == {str(k): k for k in cases}


@pytest.mark.parametrize("text,term,ok", [("pin", "pin", True), ("PIN", "pin", True), ("pin number", "pin", True), ("(pin)", "pin", True), ("shipping", "pin", False), ("spindle", "pin", False), ("pin_number", "pin", False), ("pin2", "pin", False), ("các chân cắm", "chân cắm", True)])
def test_terms(judge, text, term, ok):
    assert judge(text, None, lambda s, t: integrity.contains_term(s, term)) is ok


def test_style_pairs(judge):
    f = lambda s, t: integrity.style_pairs(s)
    assert judge("<s1>a</s1> <s2>b</s2>", None, f) == ["1", "2"] and judge("<s1><s2></s1></s2>", None, f) is None and judge("<s1>", None, f) is None and judge("x", None, f) == []


def test_trailing_child(judge):
    f = lambda s, t: integrity.repeats_fragment(s, t)
    parent = "Kiểm tra rơ le và cầu chì trước khi dùng."
    assert judge("Check.", f"{parent} Rơ le và cầu chì.", f) is True
    assert judge("Check.", f"{parent} Việc khác.", f) is False
    assert judge("a b c d. a b c d.", "e f g h. e f g h.", f) is False


def test_assess(spark):
    sources = spark.createDataFrame([("1", "Check the relay."), ("2", "Check the fuse."), ("3", "D100 = 250"), ("4", "Wait."), ("4", "Wait."), ("5", "Stop.")], "segment_id string, src string")
    supplied = spark.createDataFrame([("1", "Check the relay.", "Kiểm tra rơ le."), ("3", "D100 = 250", "D100 = 200"), ("4", "Other.", "Chờ."), ("5", "Stop.", "Dừng."), ("5", "Stop.", "Dừng."), ("9", "x", "y")], "segment_id string, src string, dst string")
    got = {r.segment_id: r.verdict for r in flow.assess(sources, supplied).collect()}
    assert got == {"1": "accepted", "2": "missing", "3": "TechnicalInvariantError", "4": "source_mismatch", "5": "duplicate", "9": "unknown_id"}
    assert {r.verdict for r in flow.assess(sources, supplied.limit(0)).collect()} == {"missing"}


def test_loader(spark):
    schema = "segment_id string, src string, logical_unit_id string, occurrence_id string, source_fragment_ids array<string>"
    good = spark.createDataFrame([("1", "a", None, None, None), ("1", "a", None, None, None), (None, "b", None, None, None)], schema)
    assert sorted(r.src for r in flow.loaded_segments(good).collect()) == ["a", "b"]
    for bad in ([("1", "a", None, None, None), ("1", "b", None, None, None)], [("1", None, None, None, None)]):
        with pytest.raises(Exception, match="source"):
            flow.loaded_segments(spark.createDataFrame(bad, schema)).collect()


def test_segment_table(spark):
    rows = [("1", "Set {v0}", "Đặt {v0}"), ("2", "x", ""), ("3", "a <s1>b</s1>", "c"), ("4", "p", "q"), ("5", None, "q")]
    got = {r.segment_id: r.dst for r in flow.segment_table(spark.createDataFrame(rows, "segment_id string, src string, dst string")).collect()}
    assert got == {"1": "Đặt <b0></b0>", "4": "q"}


@pytest.mark.parametrize("outcomes,trusted,skipped", [("FS", None, 0), ("FF", 1, 0), ("FFF", 1, 1), ("FSF", None, 0), ("FTF", 2, 0), ("FFSF", 1, 2), ("F_F", 2, 0), ("", None, 0)])
def test_two_strike(spark, outcomes, trusted, skipped):
    names = {"F": "failure", "S": "success", "T": "transport", "_": "failure"}
    rows = [("i", n, names[o], " " if o == "_" else f"r{n}") for n, o in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "identity string, seq long, outcome string, reason string")
    got = flow.two_strike(df).collect()
    assert [(r.trusted_at, r.reason) for r in got] == ([] if trusted is None else [(trusted, "r0")])
    assert flow.skipped(df).count() == skipped


def test_retry_state(spark):
    rows = [("i", n, o, e) for n, (o, e) in enumerate([("failure", "Timeout"), ("failure", "TechnicalInvariantError"), ("success", None), ("failure", "SegmentTooLongError"), *[("failure", "Timeout")] * 8])]
    got = flow.retry_state(spark.createDataFrame(rows, "identity string, seq long, outcome string, error string")).orderBy("seq").collect()
    assert [(r.attempt, r.budget, r.wait, r.stop) for r in got[:3]] == [(1, 8, 1.0, False), (2, 8, 2.0, False), (1, 1, 1.0, True)]
    assert (got[-1].attempt, got[-1].wait, got[-1].stop) == (9, 60.0, True)


def test_context_brute_force(spark):
    """Neighbours within a day and across days, in one hot manual."""
    rows = [(f"s{i:03}", "m" if i % 7 else None, ("x" * 400 if i % 5 == 0 else f"text {i // 2}"), "vi" if i % 4 else "en", f"2024-01-{1 + i // 12:02} {i % 12:02}:00:00") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:3], "segment_id string, manual_id string, src string, lang_out string, queued_at string").withColumn("queued_at", F.to_timestamp("queued_at"))
    got = {r.segment_id: r.context_id for r in flow.adjacent_context(df).collect()}
    for manual in ("m", None):
        own = [r for r in rows if r[1] == manual]
        for k, r in enumerate(own):
            near = [own[j] for j in (k - 1, k + 1) if 0 <= j < len(own)]
            fits = [n[0] for n in near if len(n[2]) <= 300 and n[2] != r[2] and n[3] == r[3]]
            assert got[r[0]] == (fits[0] if fits else None), r


def test_jobs(spark):
    long = "Check the relay and the fuse."
    rows = [("a", long, "vi"), ("b", long, "vi"), ("c", long, "de"), ("d", "Manual", "vi"), ("e", "Manual", "vi"), ("f", None, "vi")]
    keys = {r.segment_id: (r.job, r.identity) for r in flow.job_keys(spark.createDataFrame(rows, "segment_id string, src string, lang_out string")).collect()}
    assert keys["a"] == keys["b"] != keys["c"] and keys["d"] != keys["e"] and "f" not in keys
    assert keys["a"][1] == keys["c"][1] and len(keys["a"][1]) == 16
