"""Token extraction, spans and classifiers: brute force with another regular-expression engine, and cases with known results."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import scripts, spans
from spanloom.functions.tokens import EXTRACTORS, bag_minus, balanced_tags, tokens
from spanloom.operators import integrity, routing, rules, texts
from spanloom.plans.common import CASE_TEXTS, TEXTS

PLAIN = {
    "placeholders": P.PLACEHOLDER, "tags": P.TAG, "posix_paths": P.POSIX_PATH, "document_labels": P.DOCUMENT_LABEL, "ipv4": P.IPV4, "endpoints": P.ENDPOINT, "identifiers": P.IDENTIFIER,
    "standards": P.STANDARD, "versions": P.VERSION, "document_ids": P.DOCUMENT_ID, "ranges": P.RANGE, "single_letter_quantities": P.SINGLE_LETTER_QUANTITY, "polarity": P.POLARITY,
}


def many(spark, f, rows):
    """The results of ``f`` over the first values of the cases, in their order, by one job."""
    df = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, t string")
    return [r.x for r in df.select("n", f(F.col("t")).alias("x")).orderBy("n").collect()]


def one(spark, f, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(f(*[F.col(k) for k in values]).alias("x")).first().x


@pytest.fixture(scope="module")
def corpus(spark, data):
    """Every text of six tables, the cases, and texts that tease word boundaries."""
    out = set(CASE_TEXTS) | {"ＡD100 Ｄ200", "é.ini x.ini", "Việt_v1.2", "ก์Page No. 1", "Page\xa0No.x", "1,234,5 12.5.6 .5 -7", "a\x1fb https://x.y/\x85z"}
    for t, _, columns in TEXTS:
        for c in columns:
            out |= {r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).distinct().collect() if r[0]}
    return sorted(out)


def test_plain_extractors_brute_force(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "t string")
    for row in df.select("t", *[tokens(n, F.col("t")).alias(n) for n in PLAIN]).collect():
        for name, p in PLAIN.items():
            assert row[name] == [m[0] for m in re.finditer(p, row.t)], (name, row.t)


def test_shaped_extractors_brute_force(spark, corpus):
    even = lambda t: re.sub(P.QUANTITY, lambda m: f"{m[1]} {m[2].replace('μ', 'µ').replace('N.m', 'N·m')}", t)
    found = lambda p, t: [m[0] for m in re.finditer(p, t)]
    want = {
        "urls": lambda t: [x.rstrip(".,;:!?)") for x in found(P.URL, t)], "windows_paths": lambda t: [x.rstrip(".,!?)”’") for x in found(P.WINDOWS_PATH, t)],
        "file_names": lambda t: found(P.FILE_NAME, re.sub(r"(?<=[A-Za-z0-9])([.!?])(?=\s|$)", "", t)), "numbers": lambda t: found(P.NUMBER, even(t)), "units": lambda t: found(P.UNIT, even(t)),
        "quantities": lambda t: [f"{m[1]} {m[2]}" for m in re.finditer(P.QUANTITY, even(t))],
    }
    df = spark.createDataFrame([(t,) for t in corpus], "t string")
    for row in df.select("t", *[tokens(n, F.col("t")).alias(n) for n in want]).collect():
        for name, f in want.items():
            assert row[name] == f(row.t), (name, row.t)


@pytest.mark.parametrize(
    "name,text,found",
    [
        ("opcodes", "MOV D100 D200\nRun BMOV D1 D2 now\n3: IF ready THEN MOVJ P001\nNWAIT\nMOV along", ["MOV", "BMOV", "IF", "THEN", "MOVJ", "NWAIT"]),
        ("syntax", "Append `;` and `[x]` here; not;\nMOV D1 D2", [";", "[", "]"]),
        ("windows_paths", "C:\\J1C\\ 오늘날짜-시’분’초’.txt now, C:\\temp\\x.", ["C:\\J1C\\ 오늘날짜-시’분’초’.txt", "C:\\temp\\x"]),
        ("identifiers", "D100, AL.52, 0x2005, KM-757 and R[1]; D100D not", ["D100", "AL.52", "0x2005", "KM-757", "R[1]", "D100D"]),
        ("ipv4", "192.0.2.27 but not 1.2.3.4.5", ["192.0.2.27"]),
        ("numbers", "D100 is 1,234.50 or 2350mm", ["1,234.50", "2350"]),
        ("polarity", "ON OFF ON", ["ON", "OFF", "ON"]),
    ],
)
def test_token_cases(spark, name, text, found):
    assert one(spark, lambda t: tokens(name, t), t=text) == found


def test_tokens_of_null_and_long_text(spark):
    df = spark.createDataFrame([(None,), ("1 mm D100 " * 20_000,)], "t string")
    null, long = df.select(*[F.size(tokens(n, F.col("t"))).alias(n) for n in EXTRACTORS]).collect()
    assert all(null[n] == 0 for n in EXTRACTORS) and long.numbers == long.quantities == long.identifiers == 20_000


def test_bag_minus(spark):
    df = spark.createDataFrame([(list("bbac"), list("abd"))], "a array<string>, b array<string>")
    r = df.select(bag_minus(F.col("a"), F.col("b")).alias("x"), bag_minus(F.col("b"), F.col("a")).alias("y")).first()
    assert r.x == ["b", "c"] and r.y == ["d"]


@pytest.mark.parametrize("text,ok", [("Keep <b0></b0>", True), ("<A x=1><b></b></a>", True), ("<a><b></a></b>", False), ("<x/> alone", True), ("open <s2>", False), ("</s3>", False), ("plain", True)])
def test_balanced_tags(spark, text, ok):
    assert one(spark, balanced_tags, t=text) is ok


def test_scripts(spark):
    f = lambda t: F.struct(scripts.has_syllables(t).alias("narrow"), scripts.any_of(t, scripts.HANGUL).alias("wide"), scripts.any_of(t, scripts.HAN).alias("han"))
    assert tuple(one(spark, f, t="<가>x")) == (True, True, False)
    assert tuple(one(spark, f, t="ᄀ 𠮷")) == (False, True, True)
    assert one(spark, scripts.new_scripts, s="a", t="тест א") == ["Cyrillic", "Hebrew"]


YES = ["Pressure", "Safety requirements", "Set D100 to 250.", "Wait to next step", "Horizontal stroke 800mm", "안전사양", "安全要求"]
NO = ["D100", "R245", "0x2005", "IRCB50x", "Q03UDVCPU", "123", "250 mm", "192.168.1.10", "ON", "OFF", "Servo Motor", "SCARA Robot", "JOG"]


CASES = [
    ("D100 값을 250으로 설정하십시오.", True), ("Integration Test", True), ("WAIT", True), ("MOV D100 D200\nAdjust the supporting structure.", True), ("IR-S10-80Z20S-INT", False), ("R[1]", False), ("AL.52", False),
    ("TCP/502", False), ("±0.05 mm", False), ("ISO 10218-1", False), ("MOV D100 D200", False), ("IF ready THEN MOVJ P001", False), ("NWAIT", False), ("", False), (None, False), ("1 " * 50_000, False), ("relay " * 20_000, True),
]


def test_translation_and_cells(spark):
    both = [*[(t, True) for t in YES], *[(t, False) for t in NO]]
    assert many(spark, rules.translate_cell, both) == [ok for _, ok in both]
    assert many(spark, rules.needs_translation, both + CASES) == [ok for _, ok in both + CASES]


def test_preserve_reasons(spark):
    f = lambda t: rules.preserve_reason(t, F.lit(False), ("Quenthar Ltd. Asia",), {"relay": "relay"})
    got = [one(spark, f, t=t) for t in ("Quenthar Ltd. Asia.", "{v1}", "D100", "Check it.", " ", None)]
    assert got == ["reviewed_proper_name", "technical_invariant", "technical_invariant", None, None, None]


@pytest.mark.parametrize(
    "text,math",
    [("εmax", True), ("a = b + c", True), ("x²", True), ("12 + 3", True), ("Pressure", False), ("The value of x is = to the sum of all other values here", False), ("", False)],
)
def test_math(spark, text, math):
    assert one(spark, rules.is_math, t=text) is math


@pytest.mark.parametrize("text,safe", [("WARNING: Disconnect power before maintenance.", True), ("Manual", False), ("Qualification", False), ("Check the fuse.", True), ("one two three four", True)])
def test_safe_to_share(spark, text, safe):
    assert one(spark, rules.safe_to_share, t=text) is safe


def test_small_rules(spark):
    assert one(spark, rules.preferred_header, t=" <s1>Unit</s1> ") == " <s1>Đơn vị</s1> " and one(spark, rules.preferred_header, t="Other") is None
    assert one(spark, rules.translate_rotated, t="Ref. 305") is False and one(spark, rules.translate_rotated, t="Designation") is True
    assert tuple(one(spark, rules.option_label, t="(A) First")) == ("(A) ", "First")
    assert one(spark, rules.strip_markers, t="a <b 9002> b</ s1>{ v 3 }") == "a  b"
    assert one(spark, rules.raised, t=" 10+ ") == "¹⁰⁺"
    assert one(spark, rules.residual_class, t="C:\\폴더\\a.txt") == "ALLOWED_TECHNICAL_LITERAL" and one(spark, rules.residual_class, t="값") == "UNTRANSLATED_PROSE"
    assert one(spark, rules.error_class, t="Read timed out") == "E-NET-04" and one(spark, rules.error_class, t=None) == "E-UNKNOWN"
    assert one(spark, rules.context_sensitive, t="시운전 완료") is True and one(spark, rules.context_sensitive, t="D100 값") is False
    assert one(spark, rules.is_equation, t="F = m × a") is True and one(spark, rules.is_equation, t="force = mass times") is False


@pytest.mark.parametrize("a,b,newer", [("0.10.0", "0.9.0", True), ("0.2", "0.2.0", False), ("0.2.1", "0.2", True), ("1.0.0.0.1", "1", True), ("v0.2.0-rc1", "0.2", False)])
def test_versions(spark, a, b, newer):
    assert one(spark, lambda a, b: rules.version_parts(a) > rules.version_parts(b), a=a, b=b) is newer


ROUTES = [
    ("Set the communication parameters.", "google", "simple_low_risk"), ("프로그램 종료", "google", "simple_low_risk"), ("If the indicator is red, restart the controller.", "google", "simple_low_risk"),
    ("Press the Start button.", "google", "simple_low_risk"), ("Servo Motor 위치 확인 후 Start 버튼을 누른다.", "handoff", "mixed_language_context"),
    ("Set axis X speed to 100 mm/s and axis Y speed to 50 mm/s.", "handoff", "dense_object_value_associations"), ("가 " + "word " * 200, "handoff", "long_mixed_technical_unit"), (None, "google", "simple_low_risk"),
]


def test_routes(spark):
    plain = F.lit(False)
    f = routing.features(F.col("t"), plain, F.lit("unavailable"), plain, plain)
    df = spark.createDataFrame([(n, r[0]) for n, r in enumerate(ROUTES)], "n int, t string")
    rows = df.select("n", *[v.alias(k) for k, v in f.items()]).withColumn("r", routing.reason(plain)).withColumn("e", routing.engine(F.col("r"))).orderBy("n").collect()
    assert [(r.e, r.r) for r in rows] == [r[1:] for r in ROUTES]


def test_route_of_structure_and_callouts(spark):
    f = lambda **k: routing.features(F.col("t"), F.lit(k.get("r", False)), F.lit(k.get("c", "unavailable")), F.lit(k.get("o", False)), F.lit(False))
    df = spark.createDataFrame([("You must stop.",)], "t string")
    why = lambda **k: df.select(*[v.alias(n) for n, v in f(**k).items()]).select(routing.reason(F.lit(k.get("p", False))).alias("r")).first().r
    assert why(c="structural_merge") == "structural_merge" and why(o=True) == "context_sensitive_callout" and why(r=True) == "semantic_dependency_plus_complexity" and why(p=True) == "fully_preserve_eligible"
    got = spark.createDataFrame([(["inline_emphasis"],), (["callout_continuation", "same_paragraph"],), ([],), (None,)], "m array<string>").select(routing.complexity(F.col("m")).alias("c")).collect()
    assert [r.c for r in got] == ["trivial_wrap", "structural_merge", "unavailable", "unavailable"]


def test_spans_brute_force(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "t string")
    for row in df.select("t", spans.find(F.col("t"), P.IDENTIFIER, "i").alias("s"), spans.find(F.col("t"), P.UI_LABELS[0], "u", 1).alias("u")).collect():
        assert [(s.start, s.end, s.literal) for s in row.s] == [(*m.span(), m[0]) for m in re.finditer(P.IDENTIFIER, row.t)]
        assert [(s.start, s.literal) for s in row.u] == [(m.start(1), m[1].strip()) for m in re.finditer(P.UI_LABELS[0], row.t)]


def test_token_spans_brute_force(spark, data):
    from spanloom.plans import catalog

    got = {}
    for r in catalog.queries()["token_spans"](spark, data).filter("tbl = 'documents'").collect():
        got.setdefault(int(r.record_id), []).append((r.start_at, r.end_at))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text}
    for key, text in docs.items():
        found = {m.span() for p in texts.PLACED.values() for m in re.finditer(p, text)}
        want, cursor = [], 0
        while left := [x for x in found if x[0] >= cursor]:
            first = min(x[0] for x in left)
            want.append(max(x for x in left if x[0] == first))
            cursor = want[-1][1]
        assert sorted(got.get(key, [])) == want


def test_approved_and_masked(spark):
    text = '설정 화면에서 "Start" 버튼을 누르고 C:\\J1C\\ 오늘.txt 확인 Inovance Technology <b4></b4>'
    found = one(spark, spans.approved, t=text)
    assert [(s.literal, s.kind) for s in found] == [("Start", "explicit_ui_rule"), ("C:\\J1C\\ 오늘.txt", "literal_path"), ("Inovance Technology", "reviewed_proper_name")]
    masked = one(spark, spans.mask_literals, t=text)
    assert [m.id for m in masked.masks] == [5, 6, 7] and masked.masked.count("<b") == 4
    back = lambda t: F.transform(F.array(spans.mask_literals(t)), lambda m: spans.restore(m["masked"], m["masks"]))[0]
    assert tuple(one(spark, back, t=text)) == (text, None)
    lost = lambda t: F.transform(F.array(spans.mask_names(t)), lambda m: spans.restore(F.lit("nothing"), m["masks"]))[0]
    assert tuple(one(spark, lost, t=text)) == (None, "VerifiedProperNameError")
    assert tuple(one(spark, back, t="plain")) == ("plain", None)
    assert one(spark, lambda t: spans.remove_first(t, spans.approved(F.lit(text))), t="Start Start 값") == " Start 값"


def test_leftmost_longest_names(spark):
    f = lambda t: spans.names(t, ("Blue", "Blue Sky", "Sky"))
    assert [(s.start, s.literal) for s in one(spark, f, t="Blue Sky, Blue_Sky, Sky")] == [(0, "Blue Sky"), (20, "Sky")]


def test_evened(spark):
    for t in ("Straße Ｆ  <s1>x</s1>", "{v 1} É", "ﬁ ①"):
        plain = re.sub(P.FORMULA_TAG, "", re.sub(P.STYLE_TAG, "", t))
        assert one(spark, integrity.evened, t=t) == " ".join(unicodedata.normalize("NFKC", plain).casefold().split())
