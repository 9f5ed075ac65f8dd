"""Language, sentence and subject models: held-out accuracy on data and small cases."""

import glob
import random

import pandas as pd
import pytest

from spanloom.llm import language, sentences, subjects

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    s = pd.read_parquet(f"{DATA}/segments.parquet").src
    u = pd.read_parquet(f"{DATA}/logical_units.parquet").text
    t = pd.concat([s, u]).dropna().drop_duplicates()
    return t[t.str.len() < 1500].tolist()


@pytest.fixture(scope="module")
def splitter(texts):
    return sentences.fit(texts)


@pytest.fixture(scope="module")
def halves(texts):
    """A model fitted on half of the texts, and known sentences of the other half that the first does not hold."""
    rng = random.Random(4)
    mixed = rng.sample(texts, len(texts))
    fitted, other = mixed[::2], mixed[1::2]
    seen = set(sentences.known_sentences(fitted))
    return sentences.fit(fitted), [s for s in sentences.known_sentences(other) if s not in seen]


def precision_and_recall(model, composed):
    right = wrong = missed = 0
    for text, ends in composed:
        gold = {len(text[:e].rstrip()) for e in ends}
        got = {b for _, b in model.spans(text)}
        right, wrong, missed = right + len(gold & got), wrong + len(got - gold), missed + len(gold - got)
    return right / (right + wrong), right / (right + missed)


def test_sentences_held_out(halves):
    model, unseen = halves
    assert len(unseen) > 1000
    precision, recall = precision_and_recall(model, sentences.compose(unseen, [], [], 300, seed=77))
    assert precision > 0.93 and recall > 0.95


def test_unpunctuated_text_held_out(halves):
    """Three sentences in one line without a mark: each script gets most of its boundaries, most of them right."""
    model, unseen = halves
    by_script = {}
    for s in unseen:
        by_script.setdefault(sentences.script(s), []).append(s.rstrip(".。!?！？"))
    rng = random.Random(5)
    for kind in "KHJLv":
        composed = []
        for _ in range(80):
            text, ends = "", set()
            for n, s in enumerate(rng.sample(by_script[kind], 3)):
                text += ("" if kind in "HJ" or not n else " ") + s
                ends.add(len(text))
            composed.append((text, ends))
        precision, recall = precision_and_recall(model, composed)
        assert precision > 0.85 and recall > 0.8, (kind, precision, recall)


def test_short_unpunctuated_text_held_out(halves):
    """Two of the shortest sentences in one line without a mark: together they are no longer than many a single one."""
    model, unseen = halves
    by_script = {}
    for s in unseen:
        by_script.setdefault(sentences.script(s), []).append(s.rstrip(".。!?！？"))
    rng = random.Random(6)
    for kind in "KHJLvd":
        short = sorted(by_script[kind], key=len)
        short = short[: len(short) // 6]
        composed = []
        for _ in range(80):
            a, b = rng.sample(short, 2)
            text = a + ("" if kind in "HJ" else " ") + b
            composed.append((text, {len(a), len(text)}))
        precision, recall = precision_and_recall(model, composed)
        assert precision > 0.9 and recall > 0.75, (kind, precision, recall)


def test_open_places():
    """Every white space and every end of a character of a script without spaces, in lines of any length and mixed scripts."""
    texts = ["A b\u3000C\td", "", "电压80%请查 (a b) Fig. 4，继", "• Check it now.\nน้ำ ABC\xa0DEF继"]
    group = sentences.Group(texts)
    got = [(group.at.index(max(x for x in group.at if x <= a)), int(a), int(e)) for a, e in zip(group.start, group.end)]
    places = [[(a - group.at[n], e - group.at[n]) for k, a, e in got if k == n] for n in range(4)]
    assert places == [[(1, 2), (3, 4), (5, 6)], [], [(1, 1), (2, 2), (5, 5), (6, 6), (7, 8), (13, 14), (21, 21)], [(7, 8), (10, 11), (23, 24), (27, 27)]]


def test_places_surely_inside(splitter, texts):
    """Places left out of the chain change nothing, nor does the grouping of texts."""
    some = [*random.Random(8).sample(texts, 150), "Check the relay The fuse is late", "\0继电器\0请\r查\n\0", "a\ud800 b"]
    model = sentences.SentenceModel(splitter.weights, splitter.others, splitter.moves)
    model.surely = float("-inf")
    whole = list(model.all_spans(some))
    assert whole == list(splitter.all_spans(some)) == [splitter.spans(x) for x in some]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("Set D100 to 0.5 V. See Fig. 4 first.", ["Set D100 to 0.5 V.", "See Fig. 4 first."]),
        ("  Check the relay.\n\nIs it late?  ", ["Check the relay.", "Is it late?"]),
        ("• Check the relay.\n• Check the fuse.", ["• Check the relay.", "• Check the fuse."]),
        ("The relay (marked “Stop. Reset.”) is late.", ["The relay (marked “Stop. Reset.”) is late."]),
        ("请检查继电器。请检查熔断器！", ["请检查继电器。", "请检查熔断器！"]),
        ("AL.55", ["AL.55"]),
    ],
)
def test_sentence_cases(splitter, text, parts):
    assert [text[a:b] for a, b in splitter.spans(text)] == parts


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_no_sentences(splitter, text):
    assert splitter.spans(text) == []


def test_long_text(splitter):
    text = "Check the relay before operation. " * 20_000
    assert len(splitter.spans(text)) == 20_000


@pytest.fixture(scope="module")
def model():
    names = {n: k for k, v in language.NAMES.items() for n in v}
    rows = []
    for t, label, text in (("documents", "lang", "text"), ("segments", "lang_in", "src"), ("semantic_cases", "source_language", "source")):
        d = pd.read_parquet(f"{DATA}/{t}.parquet")[[label, text]].dropna()
        rows += [(names[a.strip().lower()], b) for a, b in zip(d[label], d[text]) if a.strip().lower() in names and 3 < len(b) < 1500]
    return language.train(rows)


@pytest.mark.parametrize(
    "text,langs",
    [
        ("Check the relay and the fuse before operation.", ["en"]),
        ("运行前请检查继电器和熔断器的状态。", ["zh-CN"]),
        ("運轉前請檢查繼電器與保險絲的狀態。", ["zh-TW"]),
        ("運転前にリレーとヒューズの状態を点検してください。", ["ja"]),
        ("운전 전에 릴레이 및 퓨즈의 상태를 점검하십시오. Check the relay and the fuse before operation.", ["ko", "en"]),
        ("ต้องเปลี่ยนรีเลย์เมื่อสายดินเสียหาย So sánh cầu chì với cầu đấu dây; chênh lệch phải nhỏ hơn 48.30 mm.", ["th", "vi"]),
        ("AL.55 0x1234 17.5 kW", []),
        ("", []),
    ],
)
def test_languages(model, text, langs):
    found = model.stretches([text])[0]
    assert [x[2] for x in found] == langs
    assert all(0 <= a < b <= len(text) and 0 < c <= 1.0001 for a, b, _, c in found)


@pytest.mark.parametrize(
    "text",
    [
        "Ne modifiez jamais la pompe sans l'accord écrit du service de maintenance.",
        "No cambie nunca la bomba sin la autorización por escrito del departamento.",
        "Il rapporto descrive come la porta dipende dal freno.",
        "De pomp moet worden vervangen wanneer de rem beschadigd is.",
        "Насос должен быть заменён, когда тормоз повреждён.",
        "Η αντλία πρέπει να αντικατασταθεί όταν το φρένο έχει φθαρεί.",
    ],
)
def test_languages_not_in_the_set_are_rejected(model, text):
    assert model.stretches([text]) == [[]]


def test_null_language(model):
    assert model.stretches([None, "  "]) == [[], []]


def test_lexicon_and_accuracies():
    docs = [("Check the relay and the fuse.", "electrical"), ("The relay must be replaced.", "electrical"), ("Is the relay ready?", "electrical"), ("Ask the court for the contract.", "law"), ("The court was late.", "law"), ("A new court was introduced.", "law")]
    lex = subjects.learn(docs, ["electrical", "law"])
    assert lex["relay"][0] == 0 and lex["court"][0] == 1
    assert subjects.sentence_subject("Nothing is said here.", lex, 2) == -1
    post = subjects.accuracies([((1, 1, 0, 0), 60), ((-1, 0, 0, 0), 290), ((1, 0, 0, 0), 30), ((0, 1, 0, 0), 8), ((0, 0, 0, 0), 40)])
    assert post[(1, 1, 0, 0)] > 0.9 > 0.1 > post[(-1, 0, 0, 0)]
    assert post[(0, 1, 0, 0)] > post[(0, 0, 0, 0)]
    assert subjects.accuracies([]) == {}


def test_document_votes(splitter):
    lex = {"relay": (0, 2.0), "court": (1, 2.0)}
    n, votes = subjects.document_votes("Notes on the relay\nThe relay is late. Nothing is known. Ask the court first.", splitter, lex, 2, {})
    cell = lambda subject, lexicon, section: votes[6 * subject + 2 * (lexicon + 1) + section]
    assert n == 4 and sum(votes) == 8
    assert cell(0, 1, 0) == 1 and cell(0, 1, 1) == 1 and cell(0, 0, 1) == 1 and cell(0, -1, 1) == 1
    assert cell(1, -1, 0) == 2 and cell(1, 0, 0) == 1 and cell(1, 1, 0) == 1
    assert subjects.document_votes(None, splitter, lex, 2, {}) == (0, [0] * 12)


def test_subpackage_is_not_imported_elsewhere():
    for path in glob.glob("spanloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "spanloom.llm" not in open(path).read(), path
