"""Language of documents and of each stretch in them (problem 2).

Nearest-centroid classification: character n-grams (1 to 3) of a stretch,
hashed, weighted by TF-IDF and normalised, are compared by cosine with several
centroids per language, which come from spherical k-means over labelled text.
A stretch whose best cosine lies below that centroid's limit is of no language.
The limits depend on the length of the stretch and are set where texts of the
other languages, which stand for languages not in the set, would end up.

Labels are noisy, so training first drops stretches that the centroids of
another language fit better, then clusters. Stretches are sentences and lines:
text is cut at terminal marks, line breaks and changes between scripts; what
stands in quotes or brackets stays in its sentence. Codes, quantities,
addresses and file names carry no language and are taken out beforehand.

Defined results: null, empty and blank texts, and texts of codes, quantities
and symbols alone, have no stretch. Neighbouring stretches of one language are
one stretch; its confidence is the mean of its parts, weighted by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.normal import canonical
from spanloom.llm.sampling import distinct_sample
from spanloom.sources.tables import table

LANGUAGES = ["en", "ko", "zh-CN", "zh-TW", "ja", "vi", "de", "th"]
SAMPLE_TEXTS = 5000  # labelled texts the model is fitted on, at most
SAMPLE_CHARS = 1500
CLUSTERS = 4  # centroids per language
BUCKETS = 1 << 16
SHARPNESS = 18.0
UNSURE = 0.9  # below this confidence, the other pieces of a text count
NEARLY = 0.6
LENGTHS = [15, 40]  # characters at which pieces begin to be of another class of length
KIN = [[k] if x not in ("zh-CN", "zh-TW", "ja") else [2, 3, 4] for k, x in enumerate(LANGUAGES)]  # languages of one script say nothing of those not in the set
FLOOR, CEILING = 0.2, 0.75  # of the cosine that 99 in 100 of a language's own texts reach: least and highest limit
REMEMBERED = 200_000  # distinct pieces whose result a process keeps; beyond, it starts anew

# Spellings of the languages, in lower case with "_" as "-".
NAMES = {
    "en": ["en", "eng", "english", "englisch", "영어", "英语", "英語", "tiếng anh"],
    "ko": ["ko", "kor", "korean", "한국어", "koreanisch", "韩语", "韓語", "韓国語", "tiếng hàn"],
    "zh-CN": ["zh-cn", "zh-hans", "zh-sg", "zh-hans-cn", "simplified chinese", "chinese (simplified)", "简体中文", "chs"],
    "zh-TW": ["zh-tw", "zh-hant", "zh-hk", "zh-mo", "zh-hant-tw", "traditional chinese", "chinese (traditional)", "繁體中文", "正體中文", "cht"],
    "ja": ["ja", "jpn", "japanese", "日本語", "日语", "일본어", "japanisch", "jp"],
    "vi": ["vi", "vie", "vietnamese", "tiếng việt", "tieng viet", "베트남어", "越南语", "vietnamesisch", "vn"],
    "de": ["de", "deu", "ger", "german", "deutsch", "독일어", "德语", "ドイツ語", "tiếng đức"],
    "th": ["th", "tha", "thai", "ไทย", "ภาษาไทย", "태국어", "泰语", "タイ語", "thailändisch"],
}
# Labels that name Chinese without saying which, so both.
CHINESE = ["zh", "zho", "chi", "chinese", "中文", "중국어", "chinesisch", "tiếng trung"]

_CLOSERS = "”’\"'»）)」』\\]】“"
_NESTED = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|„[^„“”]*[“”]|“[^“”„]*”|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"")
_CUT = re.compile(rf"[.!?。！？…]+[{_CLOSERS}]*(?=\s|$|[^\x00-\x7f]|[A-Z][a-z])|[。！？]+[{_CLOSERS}]*|\n+")
_CODE = re.compile(r"(?<![a-z+/=._-])[a-z+/=._-]*+\d[a-z0-9+/=._-]*+|<[^>]{0,20}>|\{[^}]{0,20}\}")
# Statements of machine programs: a word in capitals, then operands; several of them in a row.
_PROGRAM = re.compile(r"\b(?:[A-Z]{2,8}[ ,]+(?:[A-Z]?[\w.]*\d[\w.]*|[a-z]+ (?=GOTO|THEN|DO))[ ,;]*)+(?:[A-Z]{2,8}\b(?=$|\s*[\n;]))?")
_COMPANY = re.compile(r"(?:\b[A-Z]\w+ )+(?:Ltd|Inc|Corp|Co|GmbH|AG|LLC)\b\.?(?: [A-Z]\w+)*")
_LETTERS = re.compile(r"[^\W\d_²³¹⁰-₉①-⓿¼-¾]+")
# Units of measure, which are of no language.
UNITS = set("v a w hz pa mpa kpa bar psi m mm cm km µm μm nm g kg mg s ms µs μs min h n nm j kj kw kwh mw ma µa μa mv kv ω kω mω l ml rpm dpi c f k °c db x no".split())
_ENDS_WORD = re.compile(r"(?:^|[\s(（“„])(\w{1,7})\.$")
_SHORT = set("no nr fig sec abb abschn pos ltd inc co corp max approx ca z b d h s vgl bzw".split())
def script_of(c: str) -> str:
    if "가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ" or "ㄱ" <= c <= "ㆎ":
        return "K"
    if "ぁ" <= c <= "ヿ":
        return "J"
    if "一" <= c <= "鿿":
        return "H"
    if "ก" <= c <= "๛":
        return "T"
    return "L"


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences, lines and script stretches: what is classified as one."""
    nested = [m.span() for m in _NESTED.finditer(text)]
    cuts, k = [0], 0
    for m in _CUT.finditer(text):
        e = m.end()
        while k < len(nested) and nested[k][1] < e:
            k += 1
        if k < len(nested) and nested[k][0] < m.start() and (e < nested[k][1] or text[nested[k][0]] in "(（["):
            continue
        if text[e - 1] == "." and (w := _ENDS_WORD.search(text, max(0, e - 9), e)) and w[1].lower() in _SHORT:
            continue
        if m[0] == "\n" and "a" <= text[e : e + 1] <= "z" and text[m.start() - 1 : m.start()] not in (".", "!", "?"):
            continue  # a wrapped line
        cuts.append(e)
    cuts.append(len(text))
    out = []
    for a, e in zip(cuts, cuts[1:]):
        part = text[a:e]
        if not part or part.isspace():
            continue
        out += _by_script(text, a, e) if not part.isascii() else [(a, e)]
    return out


_RUN = re.compile(r"[가-힣]{2,}|[ก-๛]{2,}|[ぁ-ヿ]|[一-鿿]{2,}|[A-Za-zÀ-ɏḀ-ỹ]{2,}")


_KINDS = [("K", re.compile("[가-힣]")), ("H", re.compile("[一-鿿ぁ-ヿ]")), ("T", re.compile("[ก-๛]"))]
_WORDS = re.compile(r"[A-Za-zÀ-ɏḀ-ỹ]{2,} [a-zà-ɏḁ-ỹ]{2,} ")
# Characters that need no evening out before letters are compared.
_STRANGE = re.compile(r"[^ -~가-힣一-鿿ぁ-ゖァ-ヺー、。「」！？（），：；à-öø-ÿÀ-ÖØ-Þ“”„•°²µΩăđĩũơưạ-ỹĂĐĨŨƠƯẠ-Ỹก-๛\n\t…–—’‘]")


def _by_script(text: str, a: int, e: int) -> list[tuple[int, int]]:
    """Cut a piece where a long stretch of one script meets a long one of another."""
    part = text[a:e]
    kinds = [k for k, r in _KINDS if r.search(part)]
    if len(kinds) < 2 and not (kinds and _WORDS.search(part)):
        return [(a, e)]  # one script, or one beside codes and names
    runs: list[list] = []  # script, start, end, letters
    plain = _NESTED.sub(lambda m: " " * (m.end() - m.start()), part)
    for m in _RUN.finditer(plain):
        s = script_of(m[0][0])
        s = "H" if s == "J" else s
        if runs and runs[-1][0] == s:
            runs[-1][2], runs[-1][3] = m.end(), runs[-1][3] + len(m[0])
        else:
            runs.append([s, m.start(), m.end(), len(m[0])])
    need = {"L": 22, "K": 8, "T": 8, "H": 6}
    strong = [r for r in runs if r[3] >= need[r[0]]]
    marks = []
    for r, n in zip(strong, strong[1:]):
        if r[0] != n[0]:
            marks.append(a + n[1])
    bounds = [a, *marks, e]
    return list(zip(bounds, bounds[1:]))


def bare(text: str) -> str:
    """A piece without what belongs to no language, for classification."""
    if "." in text and ("Ltd" in text or "Inc" in text or "Co" in text):
        text = _COMPANY.sub(" ", text)
    if not text.islower():
        text = _PROGRAM.sub(" ", text)
    text = canonical(text) if _STRANGE.search(text) else text.casefold()
    return " ".join([w for w in _LETTERS.findall(_CODE.sub(" ", text)) if w not in UNITS])


def _vectors(texts: list[str], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed n-grams, weights and row starts of the TF-IDF vectors of ``texts`` (sorted by row, then n-gram)."""
    joined = ["\x02" + t + "\x03\x03" for t in texts]
    sizes = np.array([len(t) for t in joined], dtype=np.int64)
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    n = len(codes)
    h1 = codes * np.uint64(0x9E3779B97F4A7C15)
    grams = [(h1[: n - 2] >> np.uint64(40))]
    h2 = (h1[: n - 2] ^ (codes[1 : n - 1] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    grams.append(h2 >> np.uint64(40))
    h3 = (h2 ^ (codes[2:] * np.uint64(0x85EBCA77C2B2AE63))) * np.uint64(0x27D4EB2F165667C5)
    grams.append(h3 >> np.uint64(40))
    inside = rows[: n - 2] == rows[2:]
    keys = np.concatenate([(rows[: n - 2] << np.uint64(16) | g & np.uint64(BUCKETS - 1))[inside] for g in grams])
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys))).astype(np.float32)
    uniq = keys[first]
    row, gram = (uniq >> np.uint64(16)).astype(np.int64), (uniq & np.uint64(BUCKETS - 1)).astype(np.int64)
    weight = 1.0 + np.log(counts)
    if idf is not None:
        weight = weight * idf[gram]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
    if len(row):
        norm = np.sqrt(np.add.reduceat(weight * weight, starts))
        weight = weight / np.repeat(norm, np.diff(np.append(starts, len(row))))
    return row, gram, weight.astype(np.float32), starts


class LanguageModel:
    """Centroids (n-grams x centroids), the language of each, and its limits of rejection by length."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, limits: np.ndarray):
        self.idf, self.centroids, self.owner, self.limits = idf, centroids, owner, limits
        self._seen: dict[str, tuple[int, float, np.ndarray | None]] = {}
        self._bare: dict[str, str] = {}  # pieces as they stand, without what belongs to no language

    def __getstate__(self):
        return self.idf, self.centroids.astype(np.float16), self.owner, self.limits

    def __setstate__(self, state):
        self.__init__(state[0], state[1].astype(np.float32), *state[2:])

    def cosines(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.centroids.shape[1]), dtype=np.float32)
        row, gram, weight, starts = _vectors(texts, self.idf)
        if len(row):
            out[row[starts]] = np.add.reduceat(self.centroids[gram] * weight[:, None], starts, axis=0)
        return out

    def _learn(self, texts: list[str]) -> None:
        """Classify texts not seen before: the cosine of each language, and of the best centroid against its limit."""
        if len(self._seen) > REMEMBERED:
            self._seen.clear()
        for at in range(0, len(texts), 1000):
            part = texts[at : at + 1000]
            sims = self.cosines(part)
            best = sims.argmax(axis=1)
            ok = sims[np.arange(len(part)), best] >= self.limits[best, length_class(part)]
            by_lang = np.zeros((len(part), len(LANGUAGES)), dtype=np.float32)
            for c, o in enumerate(self.owner):
                np.maximum(by_lang[:, o], sims[:, c], out=by_lang[:, o])
            share = np.exp(SHARPNESS * (by_lang - by_lang.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            top = by_lang.argmax(axis=1)
            for k, t in enumerate(part):
                self._seen[t] = (int(top[k]), float(share[k, top[k]]), by_lang[k] if share[k, top[k]] < UNSURE else None) if ok[k] else (-1, 0.0, None)

    def classify(self, texts: list[str]) -> list[tuple[int, float, np.ndarray | None]]:
        """Language (number in LANGUAGES, -1: none), confidence and, where unsure, the cosine of each language."""
        seen = self._seen
        new = {t for t in texts if t not in seen}
        if new:
            if len(seen) > REMEMBERED:
                new = set(texts)
            self._learn(sorted(new))
        return [self._seen[t] for t in texts]

    def stretches(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of each text; neighbours of one language joined."""
        spots, plain = [], []
        known = self._bare
        if len(known) > REMEMBERED:
            known.clear()
        for n, t in enumerate(texts):
            if t:
                for a, e in pieces(t):
                    piece = t[a:e]
                    b = known.get(piece)
                    if b is None:
                        b = known[piece] = bare(piece)
                    if b:
                        spots.append((n, a, e))
                        plain.append(b)
        found = self.classify(plain)
        sure: dict[tuple[int, int], int] = {}  # (text, language): letters of its sure pieces
        for (n, _, _), b, (lang, _, unsure) in zip(spots, plain, found, strict=True):
            if lang >= 0 and unsure is None:
                sure[n, lang] = sure.get((n, lang), 0) + len(b)
        out: list[list] = [[] for _ in texts]
        for (n, a, e), (lang, conf, unsure) in zip(spots, found, strict=True):
            if lang < 0:
                continue
            if unsure is not None:  # the sure language of the text that fits nearly as well
                near = [(sure[n, k], k) for k in range(len(LANGUAGES)) if (n, k) in sure and unsure[k] >= NEARLY * unsure[lang]]
                if near:
                    lang = max(near)[1]
            while text_is_space(texts[n], a):
                a += 1
            while text_is_space(texts[n], e - 1):
                e -= 1
            name = LANGUAGES[lang]
            if out[n] and out[n][-1][2] == name:
                x, y, _, c = out[n][-1]
                out[n][-1] = (x, e, name, (c * (y - x) + conf * (e - a)) / (y - x + e - a))
            else:
                out[n].append((a, e, name, conf))
        return out


def text_is_space(text: str, at: int) -> bool:
    return text[at : at + 1].isspace()


def length_class(texts: list[str]) -> np.ndarray:
    return np.searchsorted(LENGTHS, np.array([len(t) for t in texts], dtype=np.int64), side="right")


def train(labelled: list[tuple[str, str]], seed: int = 3) -> LanguageModel:
    """Fit on (language, text) pairs; labels may be wrong now and then."""
    langs, texts = [], []
    for lang, text in labelled:
        for a, e in pieces(text):
            b = bare(text[a:e])
            if len(b) > 2 or b > "\x7f":
                langs.append(LANGUAGES.index(lang))
                texts.append(b)
    y = np.array(langs, dtype=np.int64)
    row, gram, _, _ = _vectors(texts, None)
    df = np.bincount(gram, minlength=BUCKETS)
    idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) + 0.3
    row, gram, weight, starts = _vectors(texts, idf)
    size = np.diff(np.append(starts, len(row)))

    def means(group: np.ndarray, count: int) -> np.ndarray:
        g = np.repeat(group, size)
        ok = g >= 0
        m = np.bincount(g[ok] * BUCKETS + gram[ok], weights=weight[ok], minlength=count * BUCKETS).reshape(count, BUCKETS).astype(np.float32)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    def sims(m: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(c[gram] * weight, starts) for c in m], axis=1)

    y = y[row[starts]]
    keep = y.copy()
    for _ in range(3):  # drop what another language fits better
        s = sims(means(keep, len(LANGUAGES)))
        keep = np.where(s.argmax(axis=1) == y, y, -1)
    rng = np.random.default_rng(seed)
    group = np.where(keep >= 0, keep * CLUSTERS + rng.integers(0, CLUSTERS, len(keep)), -1)
    total = len(LANGUAGES) * CLUSTERS
    for _ in range(6):  # spherical k-means within each language
        m = means(group, total)
        s = sims(m)
        own = np.where(np.arange(total)[None, :] // CLUSTERS == keep[:, None], s, -1)
        group = np.where(keep >= 0, own.argmax(axis=1), -1)
    m = means(group, total)
    s = sims(m)
    # Rejection: per centroid and length, between what its own texts reach and what those of other languages do.
    used = np.array([c for c in range(total) if (group == c).any()])
    limits = np.zeros((total, len(LENGTHS) + 1), dtype=np.float32)
    lengths = length_class([texts[i] for i in row[starts]])
    owner = used // CLUSTERS
    best = np.stack([s[:, used[owner == k]].max(axis=1) if (owner == k).any() else np.zeros(len(s), dtype=np.float32) for k in range(len(LANGUAGES))], axis=1)
    for k in sorted(set(owner.tolist())):
        least = 0.35 * float(np.quantile(best[keep == k, k], 0.01))  # for short pieces, whose cosines vary most
        for n in range(len(LENGTHS) + 1):
            own = best[(keep == k) & (lengths == n), k]
            other = best[(keep >= 0) & ~np.isin(keep, KIN[k]) & (lengths == n), k]
            low = float(np.quantile(own, 0.01)) if len(own) else 0.1
            high = float(np.quantile(other, 0.99)) if len(other) else 0.0
            limits[used[owner == k], n] = max(FLOOR * low, min(CEILING * low, high), least if n == 0 else 0.0)
    return LanguageModel(idf, np.ascontiguousarray(m[used].T), owner, limits[used])


def label_column(label: Column) -> Column:
    """Languages that a label names, as an array: empty for missing, blank, undetermined and unknown labels."""
    key = F.regexp_replace(F.lower(F.trim(label)), "_", "-")
    exact: dict[str, list[str]] = {n: [lang] for lang, names in NAMES.items() for n in names} | {n: ["zh-CN", "zh-TW"] for n in CHINESE}
    entries = [x for n, v in exact.items() for x in (F.lit(n), F.array(*map(F.lit, v)))]
    known = F.create_map(*entries)
    none = F.array().cast("array<string>")
    # A region or script after a known code names the same language, but Chinese is told apart above.
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.regexp_extract(key, r"^([a-z]{2,3})-[a-z0-9-]+$", 1)), none)


def labelled_sources(spark: SparkSession, folder: str) -> list[tuple[DataFrame, str, str, str, str]]:
    """(table, name, id, label, text) of the tables with language labels."""
    return [
        (table(spark, folder, "semantic_cases"), "semantic_cases", "case_id", "source_language", "source"),
        (table(spark, folder, "segments"), "segments", "segment_id", "lang_in", "src"),
        (table(spark, folder, "documents"), "documents", "doc_id", "lang", "text"),
    ]


def fit_on(spark: SparkSession, folder: str) -> LanguageModel:
    """Fit on at most SAMPLE_TEXTS labelled texts of at most SAMPLE_CHARS characters.

    The sample is of different texts, those of smallest hash, with an equal
    share for each language: the same on every run, whatever the partitioning.
    """
    parts = None
    for df, _, _, label, text in labelled_sources(spark, folder):
        one = df.select(label_column(F.col(label)).alias("langs"), F.col(text).alias("text")).filter(f"size(langs) = 1 AND length(text) BETWEEN 4 AND {SAMPLE_CHARS}")
        parts = one if parts is None else parts.unionAll(one)
    rows = distinct_sample(parts.select(F.col("langs")[0].alias("lang"), "text"), "text", SAMPLE_TEXTS, "lang")
    return train([(r.lang, r.text) for r in rows])


def stretch_rows(records: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per stretch of one language: all columns of ``records`` but text, plus start_at, end_at, lang, confidence."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start_at:int,end_at:int,lang:string,confidence:double>>")
    def stretches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            found = []
            for at in range(0, len(texts), 500):
                found += m.stretches(list(texts.iloc[at : at + 500]))
            yield pd.Series([[{"start_at": a, "end_at": b, "lang": x, "confidence": c} for a, b, x, c in f] for f in found], dtype=object)

    rest = [c for c in records.columns if c != "text"]
    return records.withColumn("_s", F.explode(stretches(F.col("text")))).select(*rest, "_s.*")


def unlabelled_languages(records: DataFrame, model: LanguageModel) -> DataFrame:
    """(tbl, record_id, lang) of each language in a text that its label does not name; ``records`` has tbl, record_id, label, text."""
    named = label_column(F.col("label"))
    rows = records.dropDuplicates(["tbl", "record_id"]).select("tbl", "record_id", named.alias("named"), "text")
    return stretch_rows(rows, model).filter(~F.array_contains("named", F.col("lang"))).select("tbl", "record_id", "lang").distinct()
