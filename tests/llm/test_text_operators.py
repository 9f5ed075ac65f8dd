"""Operators without Spark: character forms, tokenizer, repetition, pairs, packing, mixing."""

import itertools
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import mixing, normal, packing, pairs, repetition, tokenizer

VOCABULARY = tokenizer.DEFAULT_VOCABULARY


@pytest.mark.parametrize("odd,plain", [("ＡＢ１", "AB1"), ("é", "é"), ("a​b", "ab"), ("а", "a"), ("x y", "x y"), ("x y", "x y"), ("⽤", "用"), ("℃", "°C"), ("K", "K"), ("ｶﾞ", "ガ"), ("ᄀ‍ᅡ", "가"), ("a‑b", "a-b"), ("", "")])
def test_same_look(odd, plain):
    assert normal.look(odd) == normal.look(plain)
    assert normal.canonical(odd) == normal.canonical(plain)


def test_shortcut_misses_no_mapped_character():
    """Every character of the table changes alone, and beside a zero-width space, as the table says."""
    table = normal._maps()[0]
    for c in table:
        if 0xD800 <= c < 0xE000:
            continue
        alone = unicodedata.normalize("NFC", chr(c).translate(table).translate(table))
        assert normal.look(chr(c)) == alone, hex(c)
        assert normal.look("a" + chr(c) + "\u200bb") == normal.look("a" + chr(c) + "b"), hex(c)


@pytest.mark.parametrize("wide,plain", list(zip("！（），：；？", "!(),:;?")))
def test_wide_marks(wide, plain):
    assert normal.look(f"甲{wide}") == normal.look(f"甲{plain}") == normal.look(f"甲{wide}\u200b")


@pytest.mark.parametrize("a,b", [("X", "x"), ("①", "1"), ("x²", "x2"), ("é", "e"), ("a b", "ab"), ("a  b", "a b")])
def test_other_look(a, b):
    assert normal.look(a) != normal.look(b)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_forms_are_stable(text):
    assert normal.look(normal.look(text)) == normal.look(text)
    assert normal.canonical(normal.look(text)) == normal.canonical(text)


@pytest.fixture(scope="module")
def bpe():
    return tokenizer.transducer(VOCABULARY)


@pytest.mark.parametrize("text", ["", "Hello  world's 12.5 kW\n", "a" * 5000, " " * 3000 + "x", "한국어 문장입니다." * 30, "<|endoftext|>", "𠮷𩸽 ﷺ∮", "ab" * 3000])
def test_tokenizer_equals_library(bpe, text):
    tiktoken = pytest.importorskip("tiktoken")
    lib = tiktoken.Encoding("own", pat_str=tokenizer.SPLIT, mergeable_ranks=bpe.ranks, special_tokens={})
    assert bpe.encode(text) == lib.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokenizer_brute_force_and_round_trip(text):
    t = tokenizer.transducer(VOCABULARY)
    text = text.encode("utf-8", "replace").decode("utf-8")
    want = [i for w in t.split.findall(text) for i in t.merge(w.encode())]
    assert t.encode(text) == want
    assert "".join(t.decode_stream(want)) == text


def test_tokenizer_streaming_decode(bpe):
    ids = bpe.encode("ß한🙂")
    assert "".join(bpe.decode_stream(iter(ids))) == "ß한🙂"
    assert bpe.decode([bpe.ranks[b"\xed"]]) == "�"
    assert bpe.encode(None) == []


@pytest.mark.parametrize(
    "text,rejected",
    [
        ("Check the fuse. Check the fuse. Check the fuse.", True),
        ("Check the fuse.\n2. CHECK THE FUSE.\nCheck  the fuse", True),
        ("The relay is late. " + "late " * 30, True),
        ("Wait until the relay settles, " + "the relay settles, " * 8, True),
        ("A short line here." + "~" * 60, True),
        ("請備妥血管。請備妥血管。請備妥血管。請備妥血管。", True),
        ("Set D100 to 5 V after adjusting the relay. Set D200 to 8 V after adjusting the fuse.", False),
        ("1. 请备好示教器等备用物品。\n2. 请向办公室索取夹爪规则的复印件！\n3. 请对机械臂进行比较。", False),
        ("aa aa aa aa", False),
        ("", False),
    ],
)
def test_repetition(text, rejected):
    assert repetition.measure(text)[1] is rejected


def test_repetition_share():
    lost, total = repetition.repeated_chars("One two three. One two three.")
    assert (lost, total) == (12, 24)
    assert repetition.repeated_chars("x" * 300_000)[0] == 0


def _judge():
    from spanloom.llm.language import train

    rows = [("en", "Check the relay and the fuse before operation."), ("en", "The limit for the fuse is lower than the relay."), ("vi", "Kiểm tra rơ le và cầu chì trước khi vận hành."), ("vi", "Giới hạn của cầu chì luôn thấp hơn mức đó."), ("de", "Prüfen Sie Relais und Sicherung vor dem Betrieb."), ("de", "Der Grenzwert für Relais bleibt darunter."), ("ko", "운전 전에 릴레이의 상태를 점검하십시오."), ("th", "กรุณาตรวจสอบรีเลย์ก่อนเริ่มใช้งาน")]
    return pairs.PairJudge(train(rows * 4), {("L", "L"): 1.05, ("K", "L"): 1.75})


@pytest.mark.parametrize(
    "prompt,answer,want,defect",
    [
        ("Check the relay.", None, "vi", "empty"),
        ("Check the relay.", " ​…", "vi", "empty"),
        ("Check the relay.", "<s1></s1>", "vi", "empty"),
        ("Check the relay and the fuse.", "I'm sorry, but I can't help with translating this. [blocked]", "vi", "refusal"),
        ("Check the relay and the fuse.", "Xin lỗi, tôi không thể dịch nội dung này.", "vi", "refusal"),
        ("Check the relay and the fuse.", "CHECK THE RELAY AND THE FUSE.", "vi", "copied"),
        ("Check the relay and the fuse.", "Source text: “Check the relay and the fuse.”", "vi", "copied"),
        ("Kiểm tra rơ le và cầu chì trước khi vận hành.", "Prüfen Sie Relais und Sicherung vor dem Betrieb.", "en", "wrong_language"),
        ("Check the relay and the fuse before operation.", "Kiểm tra rơ le và cầu [...]", "vi", "truncated"),
        ("Check the relay and the fuse before operation.", "Kiểm tra rơ le", "vi", "truncated"),
        ("Check the relay and the fuse before operation.", "Kiểm tra rơ le và cầu chì trước khi vận hành.", "vi", None),
        ("AL.55", "AL.55", "vi", None),
        (None, None, "vi", None),
    ],
)
def test_pairs(prompt, answer, want, defect):
    assert _judge().defect(prompt, answer, want) == defect


_EXPLAINED = " The relay and the fuse are described on the next page of the manual, with their limits and tolerances." * 6


@pytest.mark.parametrize("answer,refuses", [("I'm sorry, but I can't help with translating this." + _EXPLAINED, True), (_EXPLAINED.strip() + " I'm sorry, but I can't help with translating this.", True), ("Xin lỗi, tôi không thể dịch nội dung này." + _EXPLAINED, True), (_EXPLAINED.strip(), False), ("I'm sorry for the delay." + _EXPLAINED, False)])
def test_long_refusals(answer, refuses):
    assert len(answer) > 400 and pairs.is_refusal(answer) is refuses


def test_handoff_prompt():
    assert pairs.prompt_of('["id", "text"]', "handoff") == "text"
    assert pairs.prompt_of('["id", "text"]', "other") == '["id", "text"]'
    assert pairs.prompt_of("[broken", "handoff") == "[broken"


_THAI = "กรุณาตรวจสอบรีเลย์และฟิวส์ก่อนเริ่มใช้งานเครื่องจักรทุกครั้งแล้วบันทึกค่าที่วัดได้ลงในแบบฟอร์มรายงานประจำวันก่อนส่งให้ผู้ควบคุม"


def test_long_phrase_in_a_row():
    assert len(_THAI) > 80
    for times, rejected in ((1, False), (2, True), (3, True)):
        assert repetition.measure(" ".join([_THAI] * times))[1] is rejected
    assert repetition.measure(" ".join([_THAI, _THAI[::-1]]))[1] is False


@pytest.mark.parametrize("period", [81, 120, 333, 700])
def test_long_periods_brute_force(period):
    import numpy as np

    rng = random.Random(period)
    phrase = [rng.choice("天地人山川草木花鳥風月雪") for _ in range(period)]  # pairs recur within the phrase
    head = [rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(0, 60))]
    words = head + phrase * 2 + ["丁"]
    assert repetition._in_a_row("".join(words)) >= period
    assert repetition._in_a_row("".join(head + phrase)) < period // 2
    seq = np.array([ord(w) for w in words], dtype=np.int32)
    run = lambda p: max((len(list(g)) for k, g in itertools.groupby(seq[p:] == seq[:-p]) if k), default=0)
    want = {p for p in range(81, len(seq) // 2 + 1) if run(p) >= p}
    assert period in want and want <= repetition._long_periods(seq, [])


def test_long_run_of_a_word_is_quick():
    import time

    start = time.time()
    assert repetition._in_a_row("late " * 30_000) == 4 * 29_999
    assert time.time() - start < 5


def test_bucket_bounds_are_optimal():
    import itertools

    rng = random.Random(5)
    for _ in range(20):
        h = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(8)}
        sizes = sorted(h)
        cost = lambda bounds: sum((min(b for b in bounds if b >= s) - s) * n for s, n in h.items())  # noqa: B023, E731
        best = min(cost((*c, sizes[-1])) for k in range(3) for c in itertools.combinations(sizes[:-1], k))
        assert cost(packing.bucket_bounds(h, 3)) == best


@given(st.lists(st.integers(0, 100), max_size=60))
@settings(max_examples=100, deadline=None)
def test_plan_keeps_items_and_capacity(sizes):
    h = Counter(sizes)
    plan = packing.plan_group(h, 100, packing.bucket_bounds(h))
    back = Counter()
    for pattern, times in plan:
        assert sum(s * k for s, k in pattern.items()) <= 100
        for s, k in pattern.items():
            back[s] += k * times
    assert back == h
    used = sum(t for _, t in plan)
    assert used <= max(1, 2 * sum(sizes) // 100 + 1) or not sizes


def test_other_bounds_give_other_containers():
    """The buckets shape the batches: each forms its own first."""
    rng = random.Random(9)
    h = {rng.randint(5, 100): rng.randint(1, 40) for _ in range(40)}
    plans = {str(packing.plan_group(h, 100, bounds)) for bounds in (packing.bucket_bounds(h), [max(h)], sorted(h)[::3], [20, 50])}
    assert len(plans) > 1


def test_bounds_of_many_sizes_are_exact():
    rng = random.Random(9)
    h = {s: rng.randint(1, 9) for s in rng.sample(range(5000), 1500)} | {2001: 1_000_000, 2004: 1}
    sizes = sorted(h)
    cost = lambda bounds: sum((min(b for b in bounds if b >= s) - s) * n for s, n in h.items())
    assert cost(packing.bucket_bounds(h, 2)) == min(cost((c, sizes[-1])) for c in sizes[:-1])


def test_buckets_shape_the_batches():
    h = {60: 1, 40: 1, 30: 2}
    assert ({40: 1, 30: 2}, 1) in packing.plan_group(h, 100, [50, 100])
    assert ({60: 1, 40: 1}, 1) in packing.plan_group(h, 100, [100])
    # 70 and 30 fill no batch of their own buckets, so they go across.
    assert packing.plan_group({70: 1, 30: 1}, 100, [50, 100]) == [({70: 1, 30: 1}, 1)]


def test_cube_keeps_both_totals():
    rng = random.Random(3)
    tokens = [rng.randint(1, 900) for _ in range(3000)]
    p = [0.37] * len(tokens)
    q = mixing.flight(p, tokens, 1)
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-5
    assert abs(sum(a * b for a, b in zip(q, tokens)) - sum(a * b for a, b in zip(p, tokens))) < 1e-2
    assert all(x in (0.0, 1.0) for x in mixing.land(q, tokens))
    assert mixing.flight([0.5] * 9, [7] * 9, 2).count(1.0) in (4, 5)
    assert mixing.flight([], [], 1) == []


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_subsequence_brute_force(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert pairs.common_subsequence(a, b) == best[-1][-1]


def test_pair_alignment():
    assert pairs.is_copy("Check the relay and the fuse before operation.", "“CHECK the relay and the fuse before operation”")
    long = "Check the relay, the old contactor and the main fuse before operation, please."
    assert pairs.is_copy(long, "Translation: " + long.replace("main", "many"))
    assert not pairs.is_copy(long, long.replace("main", "many").replace("old", "new").replace("relay", "belt"))
    assert not pairs.is_copy("Check the relay.", "Check the fuse.")
    assert not pairs.is_copy("Check the relay and the fuse before operation.", "Before operation, the fuse and the relay check.")
    long = "The relay is late and was postponed. " * 40
    assert pairs.is_refusal("I cannot translate this. " + long) and pairs.is_refusal(long + "I cannot translate this.")
    assert not pairs.is_refusal(long)
    assert pairs.common_subsequence("ab" * 5000, "ba" * 5000) == 9999


def test_sentence_counts():
    assert pairs.sentence_count("Khi thiếu băng tải, màn hình hiển thị “Hãy thử lại sau.” “Cất máy kéo cách xa nhà kính,” theo lời thông báo.") == 2
    korean = "화면에 “나중에 다시 시도하십시오.”라고 표시됩니다."
    assert pairs.sentence_count(korean) == pairs.sentence_count(unicodedata.normalize("NFD", korean)) == 1
    assert pairs.sentence_count("Lưu ý về ống thông\nĐặt 0xBCC7 thành 11,952 °C sau khi điều chỉnh.") == 2
    assert pairs.repeated_tail("Giới hạn là 4 V, là 4 V, là 4 V, là 4 V,") and not pairs.repeated_tail("Giới hạn là 4 V, và 5 V")


def test_long_markup_is_empty():
    judge = pairs.PairJudge(None, {})
    assert judge.defect("Check the relay.", '<span class="' + "x" * 5000 + '"></span>&nbsp;', "vi") == "empty"
    assert judge.defect("M56.²", "M56.²", "vi") is None


@pytest.mark.parametrize("seed", range(8))
def test_large_documents_leave_the_goal_in_reach(seed):
    rng = random.Random(seed)
    large = [133_306, 99_767] + [rng.randint(2_000, 3_400) for _ in range(40)]
    p = 0.37
    small = 900_000
    goal = p * (sum(large) + small)
    taken = sum(t for t, x in zip(large, mixing.decide_large(large, p, goal, small, seed), strict=True) if x)
    assert 0 <= goal - taken <= small
    assert mixing.decide_large([500, 400], 0.5, 450.0, 0.0, seed) in ([0, 1], [0, 0])
