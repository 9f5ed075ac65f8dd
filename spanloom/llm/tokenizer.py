"""Byte-level BPE as a lazily determinised finite-state transducer (problem 7).

Of every prefix of a pre-token the *last* token of its BPE encoding is unique,
and a sequence of tokens is the BPE encoding of its bytes exactly if each
adjacent pair is what BPE makes of the pair's bytes. So one pass from left to
right suffices: at each byte, the last token is the longest vocabulary entry
ending here that is compatible with the last token where it starts.

What decides about the future is bounded: the longest suffix of the bytes read
that is a proper prefix of a vocabulary entry, and the last tokens at the
places inside that suffix. These are the states. They are discovered on demand
and their transitions memoised, so common text runs through plain table
look-ups. Tokens are settled (emitted) as soon as all continuations agree on
them, which happens after a lookahead no longer than the longest entry.

Defined results: null and empty text give the empty list. Strings that spell
special tokens are ordinary text. Lone surrogates cannot occur in Parquet text;
in direct calls they are encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text before merging that belongs to the rank files (their published pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLE_EVERY = 1024  # bytes of one pre-token after which agreed tokens are emitted
MEMO = 300_000  # pre-tokens and states remembered; older ones are forgotten, never refused


class BpeTransducer:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], split: str = SPLIT):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split = regex.compile(split)
        self._prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        # State 0: nothing read. A state is (pending bytes, last token at each place in them, -1 at the start).
        self._states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self._index = {self._states[0]: 0}
        self._last = [-1]
        self._step: dict[int, int] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE by repeated merging of the lowest rank; the definition that states are checked against."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4 * MEMO:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _discover(self, state: int, byte: int) -> int:
        pending, lasts = self._states[state]
        grown = pending + bytes((byte,))
        token = -1
        for start in range(len(grown)):  # the longest entry first
            t = self.ranks.get(grown[start:])
            if t is not None and (lasts[start] < 0 or self._compatible(lasts[start], t)):
                token = t
                break
        if token < 0:
            raise ValueError("the rank file lacks a single byte")
        keep = 0
        while keep < len(grown) and grown[keep:] not in self._prefixes:
            keep += 1
        key = (grown[keep:], (*lasts, token)[keep:])
        new = self._index.get(key)
        if new is None:
            new = self._index[key] = len(self._states)
            self._states.append(key)
            self._last.append(token)
        self._step[state << 8 | byte] = new
        return new

    def _run(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        out: list[int] = []
        step, last = self._step, self._last
        state, lasts = 0, []  # last token after each byte not yet settled
        for n, byte in enumerate(data, 1):
            new = step.get(state << 8 | byte)
            state = self._discover(state, byte) if new is None else new
            lasts.append(last[state])
            if not n % SETTLE_EVERY:
                self._settle(lasts, len(self._states[state][0]), out)
        out += self._back(lasts, len(lasts))
        if len(self._states) > MEMO:
            self._reset()
        return out

    def _back(self, lasts: list[int], end: int) -> list[int]:
        ids = []
        while end > 0:
            ids.append(t := lasts[end - 1])
            end -= len(self.bytes_of[t])
        return ids[::-1]

    def _settle(self, lasts: list[int], pending: int, out: list[int]) -> None:
        """Emit what all places from which a later token may start agree on."""
        ends = {p: p for p in range(len(lasts) - pending, len(lasts) + 1)}
        cuts = set(ends)
        while len(cuts) > 1:
            top = max(cuts)
            cuts.discard(top)
            if top == 0:
                return
            cuts.add(top - len(self.bytes_of[lasts[top - 1]]))
        (cut,) = cuts
        if cut > 0:
            out += self._back(lasts, cut)
            del lasts[:cut]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self._words, []
        for word in self.split.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = self._run(word.encode("utf-8", "replace"))
                if len(word) < 64:
                    if len(words) > MEMO:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; broken bytes give U+FFFD.

        An incremental UTF-8 state machine: the state is the bytes still
        missing and the range the next one must lie in.
        """
        missing, low, high, code = 0, 0x80, 0xBF, 0
        for i in ids:
            done = []
            for b in self.bytes_of[i]:
                if missing:
                    if low <= b <= high:
                        code, missing, low, high = code << 6 | b & 0x3F, missing - 1, 0x80, 0xBF
                        if not missing:
                            done.append(chr(code))
                        continue
                    done.append("�")
                    missing, low, high = 0, 0x80, 0xBF
                if b < 0x80:
                    done.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    missing, code = 1, b & 0x1F
                elif 0xE0 <= b <= 0xEF:
                    missing, code, low, high = 2, b & 0x0F, (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
                elif 0xF0 <= b <= 0xF4:
                    missing, code, low, high = 3, b & 0x07, (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
                else:
                    done.append("�")
            if done:
                yield "".join(done)
        if missing:
            yield "�"


@functools.lru_cache(maxsize=2)
def transducer(path: str = DEFAULT_VOCABULARY) -> BpeTransducer:
    """The transducer of a rank file, one per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return BpeTransducer(ranks)


def encode_column(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Ids of a text column as array<int>."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for texts in batches:
            yield pd.Series([t.encode(x) for x in texts], dtype=object)

    return encode(text)


def count_column(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of ids of a text column, without shipping the ids back to the JVM."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for texts in batches:
            yield pd.Series([len(t.encode(x)) for x in texts], dtype="int32")

    return count(text)


def roundtrip_column(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Whether decoding the ids token by token gives the text again; a null text counts as empty."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for texts in batches:
            yield pd.Series([t.decode(t.encode(x)) == (x or "") for x in texts], dtype=bool)

    return check(text)


def encode_documents(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; no row is dropped, no text is cut, no shuffle is needed."""
    return docs.select("doc_id", encode_column(F.col("text"), path).alias("ids"))
