"""Sentence boundaries across languages and scripts (problem 3).

Every character of a text is tagged as *boundary* (a sentence ends here) or
*inside* by a linear-chain model with Viterbi decoding. Characters at which a
sentence can end have a free tag, whatever the length of the text around them:
terminal marks with their closing marks, line breaks, every white space, and in
scripts without spaces every character, unless what follows cannot begin a
sentence (a comma, a closing mark, a small letter of Japanese). The chain runs
over those, all others being inside. What stands within a pair of quotes or
brackets is inside, too. Thai sets a space between sentences.

The model is an averaged structured perceptron. It is trained here on texts
composed of known sentences of the corpus: sentences are joined with spaces,
line breaks or nothing, headings and list marks are put before them, their
lines are wrapped, and their final punctuation is stripped, before line breaks
and within lines, so that the tags are known. For Thai the known sentences come from the record starts: a space
followed by what commonly starts a record, and rarely follows a space
otherwise, separates sentences.

Defined results: null, empty and blank texts have no sentences; a text without
any boundary is one sentence; offsets count code points, the end is exclusive,
and white space around a sentence belongs to none.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.normal import look
from spanloom.llm.sampling import distinct_sample
from spanloom.sources.tables import table

SAMPLE_TEXTS = 6000  # texts the model is fitted on, at most
SAMPLE_HEADINGS = 800
SAMPLE_CHARS = 1500  # texts that are longer are not fitted on
COMPOSED = 12_000  # composed training texts
EPOCHS = 6
CAPITALS = 0.1  # share of the composed headings in capitals
STRIPPED = 0.1  # share of the composed texts whose sentences stand in one line without final marks
UNMARKED = 0.03  # share of the other sentences within a line that stand without their final marks

TERMINAL = ".!?。！？”」"
CLOSERS = r"(?:[”’\"'»）)」』\]】]|“(?!\w))*"  # the last closes German quotations, and opens others
_STOP = re.compile(rf"[.!?。！？…｡]+{CLOSERS}|\n\s*")
_STOP_OR_SPACE = re.compile(rf"[.!?。！？…｡]+{CLOSERS}|\n\s*| +")
_PAIRS = re.compile(
    r"\((?:[^()\n]|\n(?!\s*\n))*\)|（(?:[^（）\n]|\n(?!\s*\n))*）|\[(?:[^\[\]\n]|\n(?!\s*\n))*\]"
    r"|„(?:[^„“”\n]|\n(?!\s*\n))*[“”]|“(?:[^“”„\n]|\n(?!\s*\n))*”|「(?:[^「」\n]|\n(?!\s*\n))*」|『(?:[^『』\n]|\n(?!\s*\n))*』"
    r"|«(?:[^«»\n]|\n(?!\s*\n))*»|\"(?:[^\"\n]|\n(?!\s*\n))*\""
)
_MARK = re.compile(r"[ \t]*(?:[•●▪■◦‣·*–—-]|[①-⑳]|[(（]?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{2,4})[.)）、．])[ \t]*(?=\S)")
_THAI = re.compile("[ก-๛]")
_DIGIT = re.compile("[1-9]")
_VIETNAMESE, _GERMAN = re.compile("[ăđơưạ-ỹ]"), re.compile("[äöüß„]")

# Abbreviations after which a sentence goes on, and those that may end one.
ABBREVIATIONS = {
    "no.", "nos.", "nr.", "fig.", "figs.", "sec.", "sect.", "abb.", "abschn.", "pos.", "art.", "vol.", "ch.", "p.", "pp.", "para.", "tab.", "eq.", "item.",
    "e.g.", "i.e.", "cf.", "vs.", "max.", "approx.", "ca.", "z.", "b.", "d.", "h.", "s.", "u.", "a.", "bzw.", "vgl.", "inkl.", "evtl.", "st.",
    "ltd.", "inc.", "co.", "corp.", "dr.", "mr.", "mrs.", "prof.", "dipl.", "ing.", "rev.", "ref.", "ver.", "tel.", "tp.", "ths.", "ts.", "st.", "jr.",
}
_NO_START = re.compile(r"[と라이的은는이가을를고며면의도에로,，、;；:：)）\]」』”]|と|によ|という")


def char_class(c: str) -> str:
    if not c:
        return "E"
    if c.isdigit():
        return "0"
    if c < "\x80":
        return "U" if c.isupper() else "l" if c.isalpha() else c
    if "가" <= c <= "힣":
        return "K"
    if "一" <= c <= "鿿":
        return "H"
    if "ぁ" <= c <= "ヿ":
        return "J"
    if "ก" <= c <= "๛":
        return "T"
    if c in "“„「『«（":
        return "q"
    return "U" if c.isupper() else "l" if c.isalpha() else "x"


def script(text: str) -> str:
    """Script of a sentence: Thai, Japanese, Korean or Han; Vietnamese, German or other Latin."""
    c = Counter(map(char_class, text))
    for k in "TJK":
        if c[k] > 2:
            return k
    if c["H"] > 2:
        return "H"
    return "v" if _VIETNAMESE.search(text) else "d" if _GERMAN.search(text) else "L"


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each terminal mark with its closing marks, line break, and space next to Thai, that can end a sentence."""
    size = len(text)
    for m in (_STOP_OR_SPACE if _THAI.search(text) else _STOP).finditer(text):
        a, e = m.span()
        c = text[a]
        if c == "\n":
            while a and text[a - 1] in " \t\r\xa0":
                a -= 1
        elif c == " ":
            if not a or e >= size or text[e] == "\n" or not ("ก" <= text[a - 1] <= "๛" or text[a - 1] in "”)" or "ก" <= text[e] <= "๛" or text[e] == "“"):
                continue
            if text[a - 1] in TERMINAL and text[a - 1] not in "”":
                continue
        elif e < size and (n := text[e]) < "\x80" and not n.isspace() and text[e - 1] not in "。！？｡" and c not in "。！？｡":
            # Letters right after the mark: only where a capitalised word follows a word or a closing mark.
            if not (n.isupper() and a and (text[a - 1] in ")”" or text[a - 1].isalnum() and text[e + 1 : e + 2].islower())):
                continue
        yield a, e


class Place:
    """A marked place where a sentence can end, with the keys of what the model sees of it, and the number of stretches before it."""

    __slots__ = ("end", "next", "keys", "before")

    def __init__(self, end: int, nxt: int, keys: list[tuple], before: int):
        self.end, self.next, self.keys, self.before = end, nxt, keys, before


def features(key: tuple) -> list[str]:
    """The features that a key stands for; keys repeat far more often than whole contexts."""
    what, kind, x = key
    if what == "L":  # what stands before the mark
        word = x.rsplit(None, 1)[-1] if x.strip() else ""
        return [kind, kind + "w" + word[-9:], kind + "1" + x[-1:], kind + "2" + x[-2:], kind + "3" + x[-3:], kind + "5" + x[-5:]]
    if what == "R":  # what follows
        return [kind + char_class(x[:1].upper() if x[-1:] == "\x01" else x[:1]), kind + "a" + x[:1], kind + "b" + x[:2], kind + "d" + x[:4], kind + "g" + x.rstrip("\x01").split(None, 1)[0]]
    if what == "M":  # both sides
        return [kind + x[:2], kind + "m" + x[2:]]
    if what == "A":  # after an abbreviation
        return ["AB", "AB" + kind, "AB" + x]
    if what == "H":  # the line that would end here
        return ["h" + kind + x[:4], "i" + kind + " ".join(x.split()[:2])]
    return [what + kind + x, what + x, what]


class Marked:
    """The marked places of a text, its stretches between them, its pairs, and its form without cases and digits.

    A stretch is (start, end, end of the list mark that it begins with).
    """

    __slots__ = ("places", "stretches", "pairs", "low")

    def __init__(self, text: str):
        self.pairs = [m.span() for m in _PAIRS.finditer(text)]
        self.low = text.lower()
        if len(self.low) != len(text):
            self.low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.low = _DIGIT.sub("0", self.low)
        self.places, self.stretches = marked_places(text, self.low, self.pairs)


def marked_places(text: str, low: str, nested: list[tuple[int, int]]) -> tuple[list[Place], list[tuple[int, int, int]]]:
    """All marked places at which ``text`` can be divided, in order, and the stretches between the marks."""
    closing = {y: x for x, y in nested}
    out: list[Place] = []
    stretches: list[tuple[int, int, int]] = []
    k, line, size, done = 0, 0, len(text), 0  # k: next pair; line: start of the current line

    def stretch(b: int) -> None:
        mm = _MARK.match(text, line) if done == line else None
        stretches.append((done, b, mm.end() if mm else -1))

    for a, e in candidates(text):
        if a < done:
            continue
        if a > done:
            stretch(a)
        mark = text[a]
        blank = mark.isspace()
        if blank:
            pos, nxt = a, e
        else:
            pos = nxt = e
            while nxt < size and text[nxt].isspace():
                nxt += 1
        while k < len(nested) and nested[k][1] < pos:
            k += 1
        inside = False
        if k < len(nested) and nested[k][0] < a:
            # A bracket belongs to the sentence it stands in, up to its closing mark, unless it is a sentence of its own.
            x, y = nested[k]
            inside = pos < y or not blank and pos == y and text[x] in "(（[" and text[:x].rstrip(" ")[-1:] not in ("", "\n", ".", "!", "?", "。", "！", "？")
        done = nxt
        gap = text[pos:nxt]
        lines = gap.count("\n")
        if nxt >= size or not pos or mark == " " and (mm := _MARK.match(text, line)) and mm.end() >= e:
            continue  # a list mark belongs to what it stands before
        if not inside:
            kind = ("_" if mark == " " else "n") if blank else mark + ("c" if text[e - 1] != mark and text[e - 1] not in ".!?。！？…" else "")
            kind += "B" if lines > 1 else "N" if lines else "S" if gap else "0"
            at = a
            if blank and a in closing and text[a - 1] in ")）":  # look through a bracket before a line break
                at = closing[a]
                kind += ")"
            left = low[max(line, at - 10) : at].rstrip()
            nc = text[nxt]
            rc, lc = char_class(nc), char_class(text[at - 1] if at else "")
            right = low[nxt : nxt + 12]
            keys = [("L", kind, left), ("R", kind, right + "\x01" if nc.isupper() else right), ("M", kind, lc + rc + left[-2:] + "|" + right[:2])]
            if not blank:
                word = left.rsplit(None, 1)[-1] if left else ""
                if word + mark in ABBREVIATIONS or left[-2:-1] == ".":
                    keys.append(("A", kind, rc))
                if a - line < 7 and (mm := _MARK.match(text, line)) and mm.end() >= e:
                    keys += [("LM", "", "")]
            if lines or blank:
                keys.append(("H", kind, low[line : line + 14]))
                if lines:
                    listed, next_listed = _MARK.match(text, line), _MARK.match(text, nxt)
                    if next_listed:
                        keys.append(("RM", kind, ""))
                    if listed:
                        keys.append(("CM", kind, ""))
                    if listed and next_listed:
                        keys.append(("BM", kind, ""))
                    keys.append(("len", kind[:1], str(min(9, (a - line) // 12))))
            out.append(Place(pos, nxt, keys, len(stretches)))
        if lines:
            line = nxt
    if done < size:
        stretch(size)
    return out, stretches


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and its part in places without marks: white space, letter of a script without spaces, never first."""
    classes, parts = np.full(0x110000, ord("x"), np.uint8), np.zeros(0x110000, np.uint8)
    for n in range(0x10000):
        c = chr(n)
        classes[n] = ord(char_class(c))
        parts[n] = BREAK if c == "\n" else SPACE if c.isspace() else 0
    for a, b in ("、〿", "ぁヿ", "㐀䶿", "一鿿", "豈\ufaff", "！ﾟ", "\U00020000\U000323af"):
        parts[ord(a) : ord(b) + 1] |= WIDE
    for c in "、。，．：；！？,.:;!?）)」』】〕〉》]”’…・ー々ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ":
        parts[ord(c)] |= LATER
    return classes, parts


SPACE, BREAK, WIDE, LATER = 1, 2, 4, 8
CLASSES, PARTS = _character_tables()
BITS = 21  # of the hashes of the features of places without marks
BLOCK, TOGETHER = 1 << 14, 1 << 18  # places scored, and characters read, at a time


def open_places(codes: np.ndarray, stretches: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, stretch) of all places without marks at which a sentence can end.

    In every stretch, whatever its length: every white space, and every end of a
    character beside scripts without spaces, outside pairs.
    """
    part = PARTS[codes]
    edge = np.diff((part & SPACE).astype(np.int8), prepend=0, append=0)
    left, right = part[:-1], part[1:]
    between = np.flatnonzero(((left | right) & WIDE > 0) & (left & (SPACE | BREAK) == 0) & (right & (SPACE | BREAK | LATER) == 0)) + 1
    a, e = np.concatenate([np.flatnonzero(edge == 1), between]), np.concatenate([np.flatnonzero(edge == -1), between])
    order = np.argsort(a, kind="stable")
    a, e = a[order], e[order]
    s = np.searchsorted(stretches[:, 0], a) - 1
    ok = (s >= 0) & (e < stretches[s, 1]) & (e > stretches[s, 2])
    if len(pairs):
        p = np.searchsorted(pairs[:, 0], a) - 1
        ok &= (p < 0) | (pairs[p, 1] <= a)
    return a[ok], e[ok], s[ok]


def open_features(low: np.ndarray, classes: np.ndarray, a: np.ndarray, e: np.ndarray, stretches: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of the features of places without marks, one array for each kind of feature.

    ``low`` and ``classes`` have twelve line breaks before and after the texts;
    contexts end with the line.
    """
    salt = 0

    def numbered(*values: np.ndarray) -> np.ndarray:
        nonlocal salt
        salt += 2
        h = (e > a).astype(np.uint64) + np.uint64(salt)
        for v in values:
            h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)

    def grams(at: np.ndarray, step: int, sizes: tuple[int, ...], longest: int) -> list[np.ndarray]:
        """Hashes of the next characters of a line from ``at`` on, by number, and of the next word."""
        out, h, word = [], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        going = inside = np.ones(len(at), bool)
        for n in range(1, longest + 1):
            c = low[at]
            going = going & (c != 10)
            inside = inside & going & (PARTS[c] & SPACE == 0)
            c = c.astype(np.uint64)
            if n <= sizes[-1]:
                h = np.where(going, h * np.uint64(0x100000001B3) + c, h)
                if n in sizes:
                    out.append(h)
            word = np.where(inside, word * np.uint64(0x100000001B3) + c, word)
            at = np.where(going, at + step, at)  # never beyond the line
        return [*out, word]

    lc, rc = classes[a + 11], classes[e + 12]
    l1, l2, l3, l5, last = grams(a + 11, -1, (1, 2, 3, 5), 9)
    r1, r2, r4, first = grams(e + 12, 1, (1, 2, 4), 12)
    yield numbered()
    for x in (l1, l2, l3, l5, last, rc, r1, r2, r4, first):
        yield numbered(x)
    yield numbered(lc, rc)
    yield numbered(l2, r2)
    # The length of the stretch without marks, and of its parts.
    for x in (np.minimum(15, (stretches[:, 1] - stretches[:, 0]) // 12), np.minimum(9, (a - stretches[:, 0]) // 6), np.minimum(9, (stretches[:, 1] - e) // 6)):
        yield numbered(x)
        yield numbered(rc, x)


class Group:
    """Some texts with their marked places and the places without marks, these as arrays over all of them."""

    def __init__(self, texts: list[str]):
        self.marked = [Marked(x) for x in texts]
        starts = np.cumsum([0] + [len(x) + 1 for x in texts])
        codes = lambda parts: np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        shifted = lambda rows, width: np.array([[v + at if v >= 0 else v for v in r] for at, rs in zip(starts.tolist(), rows) for r in rs], np.int64).reshape(-1, width)
        own = codes(texts)
        self.stretches = shifted([m.stretches for m in self.marked], 3)
        self.first = np.cumsum([0] + [len(m.stretches) for m in self.marked]).tolist()  # stretch of each text
        self.at = starts.tolist()
        if len(self.stretches):
            self.start, self.end, self.stretch = open_places(own, self.stretches, shifted([m.pairs for m in self.marked], 2))
        else:
            self.start = self.end = self.stretch = np.zeros(0, np.int64)
        self.until = np.searchsorted(self.stretch, np.arange(len(self.stretches) + 1)).tolist()  # places before each stretch
        self.low, self.classes = np.pad(codes([m.low for m in self.marked]), 12, constant_values=10), np.pad(CLASSES[own], 12)

    def features(self) -> Iterator[Iterator[np.ndarray]]:
        for n in range(0, len(self.start), BLOCK):
            block = slice(n, n + BLOCK)
            yield open_features(self.low, self.classes, self.start[block], self.end[block], self.stretches[self.stretch[block]])


def decode(scores: list[float], moves: list[float], inside: list[int] | None = None) -> list[int]:
    """Viterbi over the places of one text; ``inside`` counts the places known to be inside before each of them, and after the last."""
    if not scores:
        return []
    m00, m01, m10, m11 = moves
    s0, s1 = float("-inf"), 0.0  # a sentence begins with the text
    back: list[tuple[bool, bool]] = []
    for n, x in enumerate([*scores, 0.0]):  # and one ends with it
        a, b = s0 + m00, s1 + m10
        if inside and inside[n]:
            s0 = (b if b > a else a) + (inside[n] - 1) * m00
            back.append((b > a, b > a))
            s0, s1 = s0 + m00, s0 + m01 + x
        else:
            c, d = s0 + m01, s1 + m11
            back.append((b > a, d > c))
            s0, s1 = (b if b > a else a), (d if d > c else c) + x
    t, out = 1, []
    for frm in reversed(back):
        t = int(frm[t])
        out.append(t)
    return out[-2::-1]


class SentenceModel:
    """Weights of the chain: per feature of marked places, per number of a feature of others, and per pair of neighbouring tags."""

    def __init__(self, weights: dict[str, float], others: np.ndarray, moves: list[float]):
        self.weights, self.others, self.moves = weights, others, moves
        self._known: dict[tuple, float] = {}
        m00, m01, m10, m11 = moves
        # A place of no higher score is inside, whatever its neighbours are.
        self.surely = min(x0 + y0 - x1 - y1 for x0, x1 in ((m00, m01), (m10, m11)) for y0, y1 in ((m00, m10), (m01, m11)))

    def __getstate__(self):
        used = np.flatnonzero(self.others)
        return self.weights, used, self.others[used], self.moves

    def __setstate__(self, state):
        weights, used, values, moves = state
        others = np.zeros(1 << BITS, np.float32)
        others[used] = values
        self.__init__(weights, others, moves)

    def score(self, key: tuple) -> float:
        x = 0.0
        for f in features(key):
            x += self.weights.get(f, 0.0)
        if len(self._known) > 400_000:
            self._known.clear()
        self._known[key] = x
        return x

    def _open(self, group: Group) -> tuple[list[int], list[float]]:
        """The places without marks, and their scores, that are not surely inside."""
        kept, scores = [], []
        for n, block in enumerate(group.features()):
            x = 0.0
            for numbers in block:
                x = x + self.others[numbers].astype(np.float64)
            found = np.flatnonzero(x > self.surely)
            kept += (found + n * BLOCK).tolist()
            scores += x[found].tolist()
        return kept, scores

    def _group_spans(self, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        group = Group(texts)
        kept, open_scores = self._open(group)
        known, score = self._known, self.score
        j = 0
        for n, (text, marked) in enumerate(zip(texts, group.marked, strict=True)):
            # (places without marks before it, end, next, score, 1 if it is without mark)
            first, begin, stop = group.first[n], group.until[group.first[n]], group.until[group.first[n + 1]]
            seq = []
            for p in marked.places:
                x = 0.0
                for key in p.keys:
                    x += known[key] if key in known else score(key)
                seq.append((group.until[first + p.before], p.end, p.next, x, 0))
            if j < len(kept) and kept[j] < stop:
                at = group.at[n]
                while j < len(kept) and kept[j] < stop:
                    k = kept[j]
                    seq.append((k, int(group.start[k]) - at, int(group.end[k]) - at, open_scores[j], 1))
                    j += 1
                seq.sort(key=lambda r: (r[0], r[4]))
            inside = []
            for r in seq:
                inside.append(r[0] - begin)
                begin = r[0] + r[4]
            inside.append(stop - begin)
            out, start, end = [], 0, len(text)
            while start < end and text[start].isspace():
                start += 1
            for r, t in zip(seq, decode([r[3] for r in seq], self.moves, inside), strict=True):
                if t and r[1] > start:
                    out.append((start, r[1]))
                    start = r[2]
            while end > start and text[end - 1].isspace():
                end -= 1
            if end > start:
                out.append((start, end))
            yield out

    def all_spans(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, int]]]:
        """(start, end) of every sentence of each text; null texts have none."""
        waiting: list[str] = []
        size = 0
        for x in texts:
            x = "" if x is None or x is pd.NA or x != x else x
            waiting.append(x)
            size += len(x)
            if size > TOGETHER:
                yield from self._group_spans(waiting)
                waiting, size = [], 0
        yield from self._group_spans(waiting)

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of every sentence of a text."""
        return next(self.all_spans([text]))


def train(composed: list[tuple[str, set[int]]], epochs: int = EPOCHS, seed: int = 7) -> SentenceModel:
    """Averaged structured perceptron on texts with known boundary ends."""
    number: dict[str, int] = {}
    data = []
    for part in range(0, len(composed), 500):
        group = Group([text for text, _ in composed[part : part + 500]])
        rows = [np.stack(list(block), axis=1) for block in group.features()]
        numbers = np.concatenate(rows) if rows else np.zeros((0, 1), np.int32)
        for n, (_, ends) in enumerate(composed[part : part + 500]):
            first, at = group.first[n], group.at[n]
            seq = [(group.until[first + p.before], 0, p.end, [(1 << BITS) + number.setdefault(f, len(number)) for key in p.keys for f in features(key)]) for p in group.marked[n].places]
            seq += [(k, 1, int(group.start[k]) - at, numbers[k]) for k in range(group.until[first], group.until[group.first[n + 1]])]
            if seq:
                seq.sort(key=lambda r: r[:2])
                starts = np.cumsum([0] + [len(r[3]) for r in seq])
                data.append((np.concatenate([r[3] for r in seq]).astype(np.int32), starts, [int(r[2] in ends) for r in seq]))
    w, total = np.zeros((1 << BITS) + len(number)), np.zeros((1 << BITS) + len(number))
    moves, moved = [0.0] * 4, [0.0] * 4
    rng, step = random.Random(seed), 1
    for _ in range(epochs):
        rng.shuffle(data)
        for ids, starts, gold in data:
            guess = decode(np.add.reduceat(w[ids], starts[:-1]).tolist(), moves)
            if guess != gold:
                for n, (g, y) in enumerate(zip(guess, gold, strict=True)):
                    if g != y:
                        at = ids[starts[n] : starts[n + 1]]
                        np.add.at(w, at, y - g)
                        np.add.at(total, at, (y - g) * step)
                for tags, d in ((gold, 1), (guess, -1)):
                    for a, b in pairwise([1, *tags, 1]):
                        moves[a * 2 + b] += d
                        moved[a * 2 + b] += d * step
            step += 1
    mean = np.round(w - total / step, 4)
    marked = {f: x for f, x in zip(number, mean[1 << BITS :].tolist(), strict=True) if x}
    return SentenceModel(marked, mean[: 1 << BITS].astype(np.float32), [v - moved[n] / step for n, v in enumerate(moves)])


def known_sentences(texts: list[str]) -> list[str]:
    """Sentences of which both ends are certain: they end in a terminal mark and hold no doubtful one."""
    starts, inner = Counter(), Counter()
    thai = [t for t in texts if len(_THAI.findall(t)) > 20]
    for t in thai:
        for piece in re.split(r"\n", t):
            piece = piece.strip()
            if len(piece) > 22 and _THAI.match(piece):
                starts[piece[:4]] += 1
            for m in re.finditer(r" +(?=([ก-๛].{3}))", piece):
                inner[m[1]] += 1
    out = []
    for t in texts:
        nested = [m.span() for m in _PAIRS.finditer(t)]
        cuts = [0]
        is_thai = bool(_THAI.search(t))
        for a, e in candidates(t):
            if any(x < e < y for x, y in nested):
                continue
            if "\n" in t[a:e]:
                # A line break after a terminal mark, or before a blank line, divides; any other is doubtful on both sides.
                sure = t.count("\n", a, e) > 1 or t[a - 1 : a] in TERMINAL
                cuts += [a, e] if sure else [-1, -1]
                continue
            rest = t[e:].lstrip(" ")
            if t[a] == " ":
                p = rest[:4]
                if is_thai and _THAI.match(p) and starts[p] >= 2 and starts[p] / (starts[p] + inner[p]) > 0.12:
                    cuts += [a, e]
                continue
            word = t[:a].rsplit(None, 1)[-1].lower() if t[:a].strip() else ""
            if t[a] == "." and (word.lstrip("(（“„") + "." in ABBREVIATIONS or _MARK.fullmatch(t[cuts[-1] if cuts[-1] >= 0 else 0 : e] + " x"[:1])):
                continue
            if rest[:1].islower() and rest[:1] < "\x80" or (t[e - 1] in "”」“’" and rest and not t[e : e + 1].isspace() and _NO_START.match(rest)):
                continue
            if t[e - 1] in "”’\"」" and "가" <= t[e : e + 1] <= "힣":
                continue
            cuts += [e, e]
        cuts.append(len(t))
        for x, y in zip(cuts[::2], cuts[1::2]):
            if x >= 0 and y > x:
                s = t[x:y].strip()
                if "\n" not in s and len(s) > 8 and (s[-1] in ".!?。！？" or s[-1] in "”」“" and s[-2:-1] in ".!?。！？" or is_thai and _THAI.search(s)) and not _MARK.match(s):
                    out.append(s)
    return out


def compose(sentences: list[str], headings: list[str], labels: list[str], count: int, seed: int = 11) -> list[tuple[str, set[int]]]:
    """Training texts with known boundaries, made of known sentences."""
    rng = random.Random(seed)
    by_script: dict[str, list[str]] = {}
    heads: dict[str, list[str]] = {}

    for s in sentences:
        by_script.setdefault(script(s), []).append(s)
    for h in headings + labels:
        heads.setdefault(script(h), []).append(h)
    kinds = sorted(by_script)
    weight = [min(len(by_script[k]), 200) for k in kinds]
    bare = re.compile(r"[.。!?！？]+$")
    out = []
    for _ in range(count if kinds else 0):
        kind = rng.choices(kinds, weight)[0]
        text, ends = "", set()
        if kind != "T" and rng.random() < STRIPPED:
            for n in range(rng.choice((1, 2, 2, 3, 3, 4, 5))):
                text += ("" if kind in "HJ" or not n else " ") + bare.sub("", rng.choice(by_script[kind]))
                ends.add(len(text))
            out.append((text, ends))
            continue
        form = rng.random()
        marks = rng.choice([lambda n: "• ", lambda n: f"{n}. ", lambda n: f"({n}) ", lambda n: f"{chr(96 + n)}) ", lambda n: f"{n}) ", lambda n: "- ", lambda n: "①②③④⑤⑥⑦⑧⑨⑩"[n - 1] + " "])
        if form < 0.45 and heads.get(kind):
            text = rng.choice(heads[kind])
            if rng.random() < CAPITALS:
                text = text.upper()
            ends.add(len(text))
            text += "\n"
        for n in range(1, rng.choice((2, 3, 3, 3, 3, 4, 4, 5, 6, 7, 8))):
            here = kind if rng.random() < 0.93 else rng.choice(kinds)
            s = rng.choice(by_script[here])
            listed = form > 0.8 or form > 0.4 and n > 2 and form < 0.45
            if rng.random() < 0.3 and " " in s:
                at = rng.choice([m.start() for m in re.finditer(" ", s)])
                if 0 < at < len(s) - 1:
                    s = s[:at] + "\n" + s[at + 1 :]
            elif here in "HJT" and rng.random() < 0.02:
                at = rng.randint(4, max(5, len(s) - 4))
                if at < len(s) - 1 and s[at - 1].isalpha() and s[at].isalpha():
                    s = s[:at] + "\n" + s[at:]
            sep = rng.random()
            gap = "\n" if listed else "\n\n" if sep < 0.1 else "\n" if sep < 0.4 else "" if here in "HJ" and sep < 0.9 or here in "LvdK" and sep > 0.96 else " "
            if rng.random() < (0.5 if listed else 0.45) and "\n" in gap:
                s = bare.sub("", s)
            elif (gap == " " or not gap and here in "HJ") and here != "T" and rng.random() < UNMARKED:
                s = bare.sub("", s)
            if listed:
                s = marks(n) + s
            text += s
            ends.add(len(text))
            text += gap
        out.append((text, ends))
    return out


def fit(texts: list[str], headings: list[str] = ()) -> SentenceModel:
    """Train on a bounded sample of texts (and heading lines, if known)."""
    texts = [t for t in texts if t and t.strip()]
    labels = [t.strip() for t in texts if len(t) < 40 and not re.search(r"[.!?。！？\n]", t)]
    heads = [look(h).strip() for h in headings if h]
    heads = [h for h in heads if h and not re.search(r"[.!?。！？\n]", h) and not _MARK.match(h)]
    return train(compose(known_sentences(texts), heads, labels[:400], COMPOSED))


def fit_on(spark: SparkSession, folder: str) -> SentenceModel:
    """Fit on at most SAMPLE_TEXTS texts, each of SAMPLE_CHARS characters at most, of segments and logical_units and SAMPLE_HEADINGS heading lines.

    The sample is the different texts of smallest hash: the same on every run,
    whatever the partitioning, and drawn by a bounded top-k.
    """
    src = table(spark, folder, "segments").select(F.col("src").alias("t"))
    units = table(spark, folder, "logical_units").select(F.col("text").alias("t"))
    longer = distinct_sample(src.unionAll(units).filter(f"length(t) BETWEEN 1 AND {SAMPLE_CHARS}"), "t", SAMPLE_TEXTS)
    heads = table(spark, folder, "fragments").filter("structural_role = 'heading' AND text IS NOT NULL AND paragraph_id IS NOT NULL")
    heads = heads.groupBy("manual_id", "page", "paragraph_id").agg(F.min_by("text", "reading_order").alias("t"))  # a heading is the first line of its block
    heads = distinct_sample(heads, "t", SAMPLE_HEADINGS)
    return fit([r.t for r in longer], [r.t for r in heads])


def sentence_spans(records: DataFrame, model: SentenceModel) -> DataFrame:
    """One row per sentence: all columns of ``records`` but text, plus start_at, end_at."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start_at:int,end_at:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            known = texts.dropna().unique()
            spans = dict(zip(known, m.all_spans(known), strict=False))
            yield pd.Series([[{"start_at": a, "end_at": b} for a, b in spans.get(x, ())] for x in texts], dtype=object)

    rest = [c for c in records.columns if c != "text"]
    return records.withColumn("_s", F.explode(spans(F.col("text")))).select(*rest, "_s.start_at", "_s.end_at")
