"""Defective prompt and response pairs (problem 6).

A pair gets at most one defect, the first that holds of:

* ``empty``: the answer is null or has no letter or figure outside markup;
* ``refusal``: it holds most of the character shingles of a refusal template,
  in the template's order (longest common subsequence of shingles);
* ``copied``: answer and prompt share nearly all token shingles and a longest
  common subsequence of nearly all tokens, after case, character forms, quotes,
  punctuation and white space are evened out; a short lead-in may precede;
* ``wrong_language``: no stretch of the answer is in the wanted language
  (centroid model of :mod:`spanloom.llm.language`);
* ``truncated``: the answer breaks off (cut mark, or no end where the prompt
  has one) or has fewer sentences, and is shorter than such answers are: the
  usual ratio of lengths is the median over all pairs of its two scripts,
  weighed with PRIOR_PAIRS of the ratio that the scripts' densities suggest.

Defined results: a prompt without letters outside codes and quantities may be
answered by itself; a null or blank prompt makes no pair and has no defect; a
null wanted language rules only ``wrong_language`` out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.language import LANGUAGES, LanguageModel, bare, pieces
from spanloom.llm.normal import canonical

SHINGLE = 5  # characters of a shingle of a refusal template
TOKENS = 3  # tokens of a shingle of a prompt
REFUSAL_SHARE = 0.78
COPY_SHARE = 0.9  # of the tokens, in order
CONTAINED = 0.6  # of the shingles: one differing token breaks TOKENS of them
LEAD_IN = 30  # characters that may surround a copy
SHORT_THAI = 0.62  # of the usual length: without marks that could be counted
SHORT_OPEN = 0.93  # of the usual length: without an end
# About how many characters each script takes for the same content, and how many pairs that is worth.
DENSITY = {"L": 1.0, "K": 0.52, "J": 0.45, "H": 0.33, "T": 0.9}
PRIOR_PAIRS = 20

# What refusals of this task say, per language, as templates without their polite openings and reasons.
REFUSALS = [
    "i can't help with translating this", "i cannot translate this", "i am not able to render the given text", "i have to decline this request", "i must refrain from handling the passage above",
    "i won't be producing this translation", "it is not permitted for me to supply a version of this", "i am unable to translate this", "i can't assist with this request",
    "tôi không thể dịch nội dung này", "việc dịch đoạn này nằm ngoài khả năng của tôi", "tôi không được phép hỗ trợ yêu cầu này", "tôi xin từ chối chuyển ngữ đoạn trên", "tôi không thể hỗ trợ yêu cầu này",
    "이 내용은 번역해 드릴 수 없습니다", "해당 문장의 번역을 거절합니다", "요청하신 작업은 도와드릴 수 없습니다",
    "我无法翻译这段内容", "我不能处理该请求", "我必须拒绝提供这份译文", "我無法翻譯這段內容", "我不能處理該請求", "我必須拒絕提供這份譯文",
    "この内容は翻訳できません", "この文の訳出はお断りします", "ご依頼にはお応えできません",
    "ich kann diesen text nicht übersetzen", "ich muss diese anfrage ablehnen", "bei dieser übersetzung kann ich nicht helfen", "die übersetzung dieses textes ist mir nicht gestattet",
    "ฉันไม่สามารถแปลข้อความนี้ได้", "ขอปฏิเสธการแปลข้อความนี้", "ไม่สามารถช่วยเหลือตามคำขอนี้ได้",
]
_CUE = re.compile(
    r"\bi\b|\bme\b|\bmy\b|tôi|번역|드릴 수 없|드릴수|거절합|[我吾]|翻訳|訳出|お断り|応え|\bich\b|\bmir\b|ปฏิเสธ|ไม่สามารถ", re.I
)
_MARKUP = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<[^\w<>]*>|&[A-Za-z]{2,31};|&#\w{1,8};")
_READABLE = re.compile(r"[^\W_]")
_INVISIBLE = re.compile("[\xad​-‏⁠-⁯﻿]")
_SOLID = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[가-힣ぁ-ヿ一-鿿ก-๛]|[^\W_가-힣ぁ-ヿ一-鿿ก-๛]+")
_CUT_MARK = re.compile(r"(?:\[\s*(?:\.{2,}|…)\s*\]|…|\.{3,}|[,，、;；(（“„「-])\s*$")
_TAIL_MARKS = re.compile(r"(?:([^\w\s])\s*(?:\1\s*){3,})$")
_END = re.compile(r"[.!?。！？][\"”’'»）)」』“]*\s*$")
_NESTED = re.compile(r"\([^()]*\)|（[^（）]*）|„[^„“”]*[“”]|“[^“”„]*”|「[^「」]*」|\"[^\"\n]*\"")
# Latin letters of either case, Vietnamese ones included (they alternate in their block).
_UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯ" + "".join(map(chr, range(0x1EA0, 0x1EFA, 2)))
_LOWER = "a-zà-öø-ÿăđĩũơư" + "".join(map(chr, range(0x1EA1, 0x1EFA, 2)))
# \x01 stands for a quotation that ends in a mark itself: the sentence ends there unless it goes on.
_INNER_END = re.compile(rf"[.!?]+(?=[\s\x01]|$|[^\x00-\x7f])|[。！？]+|\x01[.。!！?？]*(?=\s*(?:$|\n|[\x01\x02{_UPPER}一-鿿]))")
_LIST_MARK = re.compile(r"(?m)^\s*(?:[•-]|\(?\w{1,3}[.)）])\s+")
_ABBREVIATION = re.compile(r"\b(?:No|Nr|Fig|Sec|Ltd|Inc|Abb|Abschn|Pos|max|approx|ca|e\.g|i\.e|d\. h|z\. B|usw(?=\. [a-z])|ff|Typ Nr)\.(?!\s*$)")
_VIETNAMESE = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹýúùũíìĩóòõáàãéè]", re.I)
_KANA, _HANGUL, _HAN, _THAI = re.compile("[ぁ-ヿ]"), re.compile("[가-힣]"), re.compile("[一-鿿]"), re.compile("[ก-๛]")
_LATIN_WORD = re.compile(f"[{_UPPER}{_LOWER}]{{2,}}(?= [{_LOWER}])")
_CODE = re.compile(r"[A-Za-z-]*\.?\d[\w.,]*\w|\d")
_LAST_CODE = re.compile(r"(?<=\s)(?=\S*\d)\S+(?: [a-zA-ZµΩ°²]{1,4})?(?<![.!?。！？])$")
_WRAP = re.compile(rf"(?<![.!?。！？”\n])\n(?=[{_LOWER}])")

#: The script of a text as a SQL expression, for the usual ratios of lengths.
SCRIPT_SQL = "CASE WHEN {0} RLIKE '[가-힣]' THEN 'K' WHEN {0} RLIKE '[ぁ-ヿ]' THEN 'J' WHEN {0} RLIKE '[一-鿿]' THEN 'H' WHEN {0} RLIKE '[ก-๛]' THEN 'T' ELSE 'L' END"


def script(text: str) -> str:
    return "K" if _HANGUL.search(text) else "J" if _KANA.search(text) else "H" if _HAN.search(text) else "T" if _THAI.search(text) else "L"


def shingles(tokens: str | list[str], n: int) -> set:
    """Runs of ``n`` characters or tokens; a shorter text is one shingle."""
    if len(tokens) <= n:
        return {tokens if isinstance(tokens, str) else tuple(tokens)}
    if isinstance(tokens, str):
        return {tokens[i : i + n] for i in range(len(tokens) - n + 1)}
    return set(zip(*(tokens[i:] for i in range(n))))


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, by one row of bits per item of ``b`` (exact, for any length)."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def aligned_share(template: str, text: str) -> float:
    """Share of the template's shingles that stand in the text, in order: the longest common subsequence of both."""
    want = [template[i : i + SHINGLE] for i in range(max(1, len(template) - SHINGLE + 1))]
    if sum(w in text for w in want) < REFUSAL_SHARE * len(want):
        return 0.0
    have = [text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))]
    return common_subsequence(want, have) / len(want)


def is_refusal(answer: str) -> bool:
    """Whether the answer declines: short ones are aligned as a whole, longer ones by pairs of neighbouring sentences."""
    if not _CUE.search(answer):
        return False
    text = canonical(answer).replace("’", "'")
    if len(answer) <= REFUSAL_WHOLE:
        return _declines(text)
    parts = [s for s in _SENTENCE.findall(text) if s.strip()]
    # A template may span two sentences; a part without end marks is read in overlapping pieces.
    for pair in (a + b for a, b in zip(parts, [*parts[1:], ""])):
        for at in range(0, max(1, len(pair) - REFUSAL_WHOLE // 2), REFUSAL_WHOLE // 2):
            piece = pair[at : at + REFUSAL_WHOLE]
            if _CUE.search(piece) and _declines(piece):
                return True
    return False


def _declines(text: str) -> bool:
    return any(aligned_share(t, text) >= REFUSAL_SHARE for t in _TEMPLATES)


REFUSAL_WHOLE = 400  # characters that are aligned at once
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？\n]+|$)")


_TEMPLATES = [canonical(t) for t in REFUSALS]


def solid(text: str) -> str:
    """Letters and figures alone, evened out."""
    return "".join(_SOLID.findall(canonical(text)))


def word_tokens(text: str) -> list[str]:
    """Words; in scripts whose words are not spaced alike, characters."""
    return _TOKEN.findall(canonical(text))


def is_copy(prompt: str, answer: str) -> bool:
    p, a = solid(prompt), solid(answer)
    if not p or not a:
        return False
    if p == a:
        return True
    if p in a:
        return len(a) - len(p) <= LEAD_IN
    if not 0.85 <= len(a) / len(p) <= 1.25 + LEAD_IN / len(p):
        return False
    tp, ta = word_tokens(prompt), word_tokens(answer)
    sp, sa = shingles(tp, TOKENS), shingles(ta, TOKENS)
    if len(sp & sa) < CONTAINED * min(len(sp), len(sa)):
        return False
    weight = sum(map(len, ta)) / len(ta)  # characters of a token, for the lead-in
    return common_subsequence(tp, ta) >= COPY_SHARE * max(len(tp), len(ta) - LEAD_IN / weight)


def prompt_of(text: str | None, engine: str | None) -> str | None:
    """The text of a prompt; hand-off rows may hold a JSON array of id and text."""
    if text and engine == "handoff" and text.startswith("["):
        try:
            parts = json.loads(text)
        except ValueError:
            return text
        if isinstance(parts, list) and parts and isinstance(parts[-1], str):
            return parts[-1]
    return text


def sentence_count(text: str) -> int:
    """Sentences and headings, by marks and lines alone."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "(" in text or "“" in text or "（" in text or "「" in text or "„" in text or '"' in text:
        text = _NESTED.sub(lambda m: "" if m[0][0] in "(（" else "\x01" if _END.search(m[0]) else "\x02", text)
    text = _ABBREVIATION.sub("", _LIST_MARK.sub("", _WRAP.sub(" ", text)))
    count = 0
    for line in text.split("\n"):
        line = line.strip()
        if line:
            ends = [m.end() for m in _INNER_END.finditer(line)]
            count += len(ends) + (not ends or ends[-1] < len(line) - 1)
    return count


def repeated_tail(text: str) -> bool:
    """Whether a text ends in three copies of a phrase in a row; the last may be followed by marks."""
    body = re.sub(r"[\s\W]+$", "", text.lower())
    end = len(body)
    for n in range(4, end // 3 + 1):
        if body[end - 1] == body[end - 1 - n] and body[end - n :] == body[end - 2 * n : end - n] == body[end - 3 * n : end - 2 * n]:
            return True
    return False


def last_sentence(text: str) -> int:
    """Where the last sentence begins, by marks and lines alone."""
    start, body = 0, text.rstrip()
    for m in re.finditer(r"[.!?](?=\s)|[。！？]|\n", body):
        if m.end() < len(body):
            start = m.end()
    return start


def clearly(want: str | None, text: str) -> bool:
    """The text is evidently in the wanted language, by its letters alone."""
    n = len(text)
    if want == "vi":
        return len(_VIETNAMESE.findall(text)) >= 0.1 * n and not (_HAN.search(text) or _HANGUL.search(text) or _THAI.search(text))
    if want == "ko":
        return len(_HANGUL.findall(text)) >= 0.3 * n
    if want == "ja":
        return len(_KANA.findall(text)) >= 0.2 * n
    if want == "th":
        return len(_THAI.findall(text)) >= 0.4 * n
    return False


HAN_LANGUAGES = {LANGUAGES.index(x) for x in ("zh-CN", "zh-TW", "ja")}


class PairJudge:
    def __init__(self, model: LanguageModel, ratios: dict[tuple[str, str], float]):
        self.model, self.ratios = model, ratios

    def defect(self, prompt: str | None, answer: str | None, want: str | None) -> str | None:
        if not prompt or not _READABLE.search(prompt):
            return None
        plain = _INVISIBLE.sub("", _MARKUP.sub(" ", answer)) if answer else ""
        if not _READABLE.search(plain):
            return "empty"
        if is_refusal(plain) and not is_refusal(prompt):
            return "refusal"
        clear = clearly(want, plain)
        if not clear or clearly(want, prompt):
            worded = bare(prompt)
            if worded:
                if is_copy(prompt, plain):
                    return "copied"
                if not clear and want in LANGUAGES and self.elsewhere(plain, LANGUAGES.index(want)):
                    return "wrong_language"
            elif solid(prompt) == solid(plain):
                return None
        return "truncated" if self.breaks_off(prompt, plain) else None

    def elsewhere(self, answer: str, want: int) -> bool:
        """No piece of the answer is, or could be, in the wanted language."""
        texts = [b for b in (bare(answer[a:e]) for a, e in pieces(answer)) if b]
        if want in HAN_LANGUAGES and len("".join(texts)) < 8 and all(_HAN.match(c) for t in texts for c in t if c != " "):
            return False  # a few Han characters alone may be of any of these
        found = [x for x in self.model.classify(texts) if x[0] >= 0]
        return bool(found) and all(lang != want and (unsure is None or unsure[want] < 0.6 * unsure[lang]) for lang, _, unsure in found)

    def usual(self, prompt: str, ps: str, ans: str) -> float:
        """Usual ratio of lengths; of a prompt in several scripts, by their shares."""
        han = len(_HAN.findall(prompt))
        found = {"K": 1.4 * len(_HANGUL.findall(prompt)), "T": float(len(_THAI.findall(prompt))), "J": 0.0, "H": 0.0}  # Hangul with its spaces
        if ps == "J" or _KANA.search(prompt):
            found["J"] = float(len(_KANA.findall(prompt)) + han)
        else:
            found["H"] = float(han)
        latin = sum(map(len, _LATIN_WORD.findall(prompt)))
        found["L"] = 1.2 * latin if latin > 30 or ps == "L" else 0.0
        parts = [(n, self.ratios[s, ans]) for s, n in found.items() if n and (s, ans) in self.ratios]
        total = sum(n for n, _ in parts)
        return sum(n * r for n, r in parts) / total if total else self.ratios.get((ps, ans), DENSITY[ans] / DENSITY[ps])

    def breaks_off(self, prompt: str, answer: str) -> bool:
        """Whether the answer stops too early; one that ends in a phrase said three times over has not stopped, but runs on."""
        return self.stops_early(prompt, answer) and not repeated_tail(answer)

    def stops_early(self, prompt: str, answer: str) -> bool:
        body = _TAIL_MARKS.sub(lambda m: m[1] if m[1] in ".!?。！？" else "", answer.rstrip()).rstrip()
        if _CUT_MARK.search(body) and not _CUT_MARK.search(prompt.rstrip()):
            return True
        if (code := _LAST_CODE.search(prompt)) and body.endswith(code[0]):
            return False  # both end in the same code
        ps, ans = script(prompt), script(body)
        usual = self.usual(prompt, ps, ans)
        size = len(body) / max(1, len(_INVISIBLE.sub("", prompt)))
        closed = _END.search(body) is not None
        rel = size / usual
        if not closed and ans != "T":
            if _END.search(prompt):
                return rel < SHORT_OPEN or body[-1:].isalpha()
            if len(prompt) > 25 and rel < 0.7:
                return True
        if rel < 0.95 and len(prompt) > 30:
            if ps == "T" or ans == "T":
                return rel < SHORT_THAI
            codes = _CODE.findall(prompt)
            if closed and codes and body.count(codes[-1]) >= prompt.count(codes[-1]) and prompt.rfind(codes[-1]) >= min(last_sentence(prompt), 0.6 * len(prompt)):
                return False  # the last code of the prompt, which stands in or near its last sentence, is covered
            asked = sentence_count(prompt)
            missing = asked - sentence_count(body)
            # A missing sentence makes an answer shorter by about its share; half of that is asked for.
            return missing >= 1 and rel < 1 - 0.5 * missing / asked or rel < 0.45
        return False


def usual_ratios(pairs: DataFrame) -> dict[tuple[str, str], float]:
    """Usual ratio of answer length to prompt length per pair of scripts, over all pairs, each id once (at most 25 rows).

    The exact median of the ratios in steps of a hundredth, from their
    histogram, so that it depends on no partitioning. PRIOR_PAIRS pairs of the
    ratio that the densities of the scripts suggest count along; a pair of
    scripts without any row has that ratio.
    """
    p, a = SCRIPT_SQL.format("prompt"), SCRIPT_SQL.format("answer")
    sized = pairs.filter("length(prompt) > 30 AND length(answer) > 10").selectExpr("tbl", "record_id", f"{p} AS p", f"{a} AS a", "round(length(answer) / length(prompt), 2) AS r")
    seen = sized.dropDuplicates(["tbl", "record_id"]).groupBy("p", "a", "r").agg(F.count("*").alias("n"))
    prior = [(x, y, round(DENSITY[y] / DENSITY[x], 2), PRIOR_PAIRS) for x in DENSITY for y in DENSITY]
    both = seen.unionByName(pairs.sparkSession.createDataFrame(prior, "p string, a string, r double, n long"))
    rows = both.groupBy("p", "a").agg(F.expr("percentile(r, 0.5, n)").alias("r")).collect()
    return {(x.p, x.a): x.r for x in rows}


def defective_pairs(pairs: DataFrame, model: LanguageModel, ratios: dict[tuple[str, str], float]) -> DataFrame:
    """(tbl, record_id, defect) of the defective rows; ``pairs`` has tbl, record_id, prompt, answer, want, engine."""
    shared = pairs.sparkSession.sparkContext.broadcast(PairJudge(model, ratios))

    @F.pandas_udf("string")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        j = shared.value
        known: dict[tuple, str | None] = {}
        for prompts, answers, wants, engines in batches:
            out = []
            for row in zip(prompts, answers, wants, engines, strict=True):
                if row not in known:
                    if len(known) > 100_000:
                        known.clear()
                    p, a, w, e = (None if x is None or x != x else x for x in row)
                    known[row] = j.defect(prompt_of(p, e), a, w)
                out.append(known[row])
            yield pd.Series(out, dtype=object)

    rows = pairs.dropDuplicates(["tbl", "record_id"]).withColumn("defect", judge("prompt", "answer", "want", "engine"))
    return rows.filter("defect IS NOT NULL").select("tbl", "record_id", "defect")
