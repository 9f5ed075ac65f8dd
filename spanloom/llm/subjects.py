"""Subject areas of documents (problem 9).

Four labelling functions vote on every (sentence, subject):

* lexicon: the sentence holds terms of the subject (1) or of another one (-1);
  a sentence without known terms is left open (0);
* section: the heading above the sentence holds terms of it (it says nothing
  against another subject, as documents of two subjects have one heading);
* address: the other documents of the same manual deal with it more, or less,
  than all documents do;
* source: the same for the other documents of the same source.

A latent-variable model learns how accurate each function is from how the votes
agree over *all* sentences (expectation maximisation on the counts of the 54
vote patterns), and gives the posterior probability of a subject for each
pattern. A sentence is assigned the subjects of posterior 1/2 or more, and a
document those that a quarter of its sentences or more are assigned.

The lexicon is fitted on a bounded sample of rater labels: n-grams (of words;
of characters where words are not spaced) which occur mostly in documents of
one subject. Raters' contradictions are settled by majority first.

Defined results: null, empty and blank texts, and texts of no known term, have
no subject; labels of unknown subjects or documents are ignored; spelling of
labels is evened out; without labels there are no subjects. A null manual or
source has no vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import sentences
from spanloom.llm.normal import canonical
from spanloom.llm.sampling import bounded_sample
from spanloom.session import cut_lineage
from spanloom.sources.tables import spread, table

LABELLED_DOCS = 8000  # labelled documents the lexicon is fitted on, at most
LEAST_DOCS = 2  # labelled documents a term must stand in
PURITY = 0.72
WITHIN = 0.8  # share of a term's documents in which a longer one stands
SHARE = 0.25  # of a document's sentences
STRENGTH = 0.8  # score a sentence needs to deal with a subject
HEADING = 80  # characters that a heading has fewer of
SALTS = 16  # parts of a hot manual or source

_RUN = re.compile(r"[가-힣]+|[一-鿿]+|[ァ-ヺー]+|[ก-๛]+|[^\W\d_ぁ-ヿ一-鿿가-힣ก-๛]+")


def terms(text: str) -> set[str]:
    """Candidate terms of a text."""
    out: set[str] = set()
    latin: list[str] = []
    for m in _RUN.finditer(text):
        r = m[0]
        c = r[0]
        if "가" <= c <= "힣":  # particles follow the stem
            out.update(r[:n] for n in (2, 3, 4) if len(r) >= n)
        elif c > "ก" and "ก" <= c <= "๛":
            out.update(r[i : i + n] for n in (5, 7) for i in range(len(r) - n + 1))
        elif "一" <= c <= "鿿":
            out.update(r[i : i + n] for n in (2, 3) for i in range(len(r) - n + 1))
        elif "ァ" <= c <= "ー":
            out.update(r[i : i + n] for n in (3, 5) for i in range(len(r) - n + 1))
            out.add(r)
        else:
            latin.append(r)
            if len(r) > 3:
                out.add(r)
    out.update(f"{a} {b}" for a, b in zip(latin, latin[1:]))
    return out


def learn(docs: list[tuple[str, str]], subjects: list[str]) -> dict[str, tuple[int, float]]:
    """Lexicon term -> (subject, weight) from (text, subject) pairs."""
    index = {s: n for n, s in enumerate(subjects)}
    size = Counter(s for _, s in docs)
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, s in docs:
        for t in terms(canonical(text)):
            seen[t][index[s]] += 1
    scale = [len(docs) / len(subjects) / max(1, size[s]) for s in subjects]
    out = {}
    for t, by in seen.items():
        best = max(by, key=lambda k: (by[k] * scale[k], -k))
        n = by[best]
        if n < LEAST_DOCS:
            continue
        total = sum(k * scale[s] for s, k in by.items())
        purity = (n * scale[best]) / (total + 0.5)
        if purity >= PURITY * (1 - 0.5 / n):
            out[t] = (best, round(min(2.5, math.log(purity / (1.02 - purity))) * (1 - 1 / (n + 1)), 3))

    def halves(t: str) -> list[str]:
        return t.split(" ") if " " in t else [t[:2], t[1:]] if len(t) == 3 and "一" <= t[0] <= "鿿" else []

    def pure(t: str, subject: int) -> bool:
        return t in out and out[t][0] == subject

    # A longer term with a general half adds nothing to its other half: "sheet is".
    general = {t for t, (best, _) in out.items() if (h := halves(t)) and sum(pure(w, best) for w in h) == 1}
    out = {t: v for t, v in out.items() if t not in general}
    # A term that nearly always stands within one longer term is known only as its part: "sheet" of "balance sheet".
    parts = set()
    for t, (best, _) in out.items():
        if (h := halves(t)) and all(pure(w, best) for w in h):
            parts.update(w for w in h if seen[t][best] >= WITHIN * seen[w][best])
    return {t: v for t, v in out.items() if t not in parts}


def sentence_subject(text: str, lexicon: dict[str, tuple[int, float]], count: int) -> int:
    """The subject a sentence deals with, or -1."""
    score = [0.0] * count
    for t in terms(canonical(text)):
        hit = lexicon.get(t)
        if hit:
            score[hit[0]] += hit[1]
    best = max(range(count), key=score.__getitem__)
    rest = max((x for k, x in enumerate(score) if k != best), default=0.0)
    return best if score[best] >= STRENGTH and score[best] > 1.3 * rest else -1


def document_votes(text: str | None, model: sentences.SentenceModel, lexicon: dict[str, tuple[int, float]], count: int, known: dict[str, int], spans: list[tuple[int, int]] | None = None) -> tuple[int, list[int]]:
    """(sentences, how many of them have each pair of lexicon and section votes, per subject) of a text.

    The numbers stand flat: at ``6 * subject + 2 * (lexicon + 1) + section``.
    ``spans`` are the places of the sentences, if known.
    """
    votes = [0] * (6 * count)
    spans = model.spans(text) if spans is None else spans
    head = -1  # subject of the heading above
    pairs: dict[tuple[int, int], int] = {}
    for a, b in spans:
        s = text[a:b]
        k = known.get(s)
        if k is None:
            if len(known) > 200_000:
                known.clear()
            k = known[s] = sentence_subject(s, lexicon, count)
        if text[b : b + 1] == "\n" and s[-1] not in ".!?。！？”」“" and len(s) < HEADING:
            pairs[k, -1] = pairs.get((k, -1), 0) + 1  # a heading has none above itself
            head = k
        else:
            pairs[k, head] = pairs.get((k, head), 0) + 1
    for (k, h), n in pairs.items():
        for subject in range(count):
            lex = 0 if k < 0 else 1 if k == subject else -1
            votes[6 * subject + 2 * (lex + 1) + (h == subject)] += n
    return len(spans), votes


def fit_lexicon(spark: SparkSession, folder: str) -> tuple[list[str], dict[str, tuple[int, float]]]:
    """Subjects and lexicon, from at most LABELLED_DOCS labelled documents (those of smallest id hash)."""
    names = [r.subject for r in table(spark, folder, "subject_areas").select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    labels = table(spark, folder, "doc_subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(names))
    votes = labels.groupBy("doc_id", "subject").count()
    per = votes.groupBy("doc_id").agg(F.max("count").alias("most"), F.collect_list(F.struct("subject", "count")).alias("v"))
    # Documents whose raters agree on one subject: no other has as many votes. At most one row per subject is gathered.
    sure = per.withColumn("top", F.expr("filter(v, x -> x.count = most)")).filter("size(top) = 1").select("doc_id", F.col("top")[0]["subject"].alias("subject"))
    # Ids alone are sampled; the texts of those chosen are then looked up, whole.
    chosen = bounded_sample(sure, labels.count(), "doc_id", LABELLED_DOCS)
    if not chosen:
        return names, {}
    picked = spark.createDataFrame([(r.doc_id, r.subject) for r in chosen], "doc_id long, subject string")
    docs = table(spark, folder, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    rows = docs.join(F.broadcast(picked), "doc_id").orderBy("doc_id").collect()  # at most LABELLED_DOCS
    return names, learn([(r.text, r.subject) for r in rows], names) if rows else {}


def accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior probability of each vote pattern (votes 1, -1, 0 for none) by expectation maximisation on their counts."""
    if not patterns:
        return {}
    width = len(patterns[0][0])
    prior = 0.12
    # P(vote | true), P(vote | false) per function; the first function starts as the most trusted.
    yes = [{1: 0.85, -1: 0.02, 0: 0.13} if j == 0 else {1: 0.4, -1: 0.25, 0: 0.35} for j in range(width)]
    no = [{1: 0.02, -1: 0.85, 0: 0.13} if j == 0 else {1: 0.25, -1: 0.4, 0: 0.35} for j in range(width)]
    post: dict[tuple[int, ...], float] = {}
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        for v, _ in patterns:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                a, b = a * yes[j][x], b * no[j][x]
            post[v] = a / (a + b)
        mass = sum(n * post[v] for v, n in patterns)
        prior = min(0.95, max(0.001, mass / total))
        for j in range(width):
            for x in (1, -1, 0):
                t = sum(n * post[v] for v, n in patterns if v[j] == x)
                f = sum(n * (1 - post[v]) for v, n in patterns if v[j] == x)
                yes[j][x] = (t + 1) / (mass + 3)
                no[j][x] = (f + 1) / (total - mass + 3)
    return post


def _others(docs: DataFrame, key: str, count: int) -> DataFrame:
    """``docs`` with ``{key}_sums``: sentences per subject of all documents of the same ``key``.

    A key may hold a third of all documents, so the join is salted: the groups
    are few numbers each, and copied once per salt.
    """
    sums = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("own")[k]) for k in range(count)]).alias(f"{key}_sums"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "salt"], "left").drop("salt")


def _lift_votes(key: str, overall: list[float], high: float, low: float) -> Column:
    """Vote per subject: how much more than usual the other documents of the key deal with it; 0 without any."""
    all_ = sum(overall) or 1.0
    usual = F.array(*[F.lit(max(x, 1e-9) / all_) for x in overall])
    rest = F.zip_with(f"{key}_sums", "own", lambda g, o: (g - o).cast("double"))
    total = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x)
    lift = F.zip_with(rest, usual, lambda x, u: x / total / u)
    votes = F.transform(lift, lambda x: F.when(x >= high, 1).when(x <= low, -1).otherwise(0))
    return F.when(F.col(f"{key}_sums").isNotNull() & (total > 0), votes).otherwise(F.array(*[F.lit(0)] * len(overall)))


def document_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subject, share, posterior) of the subjects of every document; the posterior is the mean over its sentences of that subject."""
    schema = "doc_id long, subject string, share double, posterior double"
    names, lexicon = fit_lexicon(spark, folder)
    if not lexicon:
        return spark.createDataFrame([], schema)
    count = len(names)
    shared = spark.sparkContext.broadcast((sentences.fit_on(spark, folder), lexicon))

    @F.pandas_udf("n int, votes array<int>")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, lex = shared.value
        known: dict[str, int] = {}
        for texts in batches:
            rows = [document_votes(t, model, lex, count, known, s) for t, s in zip(texts, model.all_spans(texts), strict=True)]
            yield pd.DataFrame({"n": [r[0] for r in rows], "votes": [r[1] for r in rows]})

    docs = spread(table(spark, folder, "documents").select("doc_id", "manual_id", "source", "text"), "doc_id")
    counted = docs.select("doc_id", "manual_id", "source", vote(F.col("text")).alias("v")).select("doc_id", "manual_id", "source", "v.n", "v.votes")
    counted = cut_lineage(counted).filter("n > 0")  # small: no texts
    own = F.array(*[F.col("votes")[6 * k + 4] + F.col("votes")[6 * k + 5] for k in range(count)])
    voted = counted.withColumn("own", own)
    overall = voted.agg(*[F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(count)]).first()
    overall = [float(x or 0) for x in overall]
    voted = _others(_others(voted, "manual_id", count), "source", count)
    voted = voted.select("doc_id", "n", "votes", _lift_votes("manual_id", overall, 2.0, 0.4).alias("address"), _lift_votes("source", overall, 1.3, 0.7).alias("origin"))

    # Counts of the 54 patterns (lexicon, section, address, source) over all sentences and subjects.
    cell = F.explode(F.expr("filter(transform(votes, (c, i) -> struct(int(i DIV 6) AS k, int(i % 6) AS j, c AS c)), x -> x.c > 0)"))
    cells = voted.select("address", "origin", cell.alias("x")).select(F.col("x.j").alias("j"), F.expr("address[x.k]").alias("a"), F.expr("origin[x.k]").alias("o"), "x.c")
    seen = cells.groupBy("j", "a", "o").agg(F.sum("c").alias("n")).collect()  # at most 54 rows
    post = accuracies([((r.j // 2 - 1, r.j % 2, r.a, r.o), r.n) for r in seen])
    flat = [post.get((j // 2 - 1, j % 2, a, o), 0.0) for j in range(6) for a in (-1, 0, 1) for o in (-1, 0, 1)]
    judged = voted.withColumn("p", F.array(*[F.lit(float(x)) for x in flat]))
    per = F.expr(
        f"""transform(sequence(0, {count - 1}), k -> aggregate(sequence(0, 5), named_struct('c', 0, 'p', 0.0D),
        (s, j) -> IF(p[j * 9 + (address[k] + 1) * 3 + origin[k] + 1] >= 0.5, named_struct('c', s.c + votes[k * 6 + j], 'p', s.p + votes[k * 6 + j] * p[j * 9 + (address[k] + 1) * 3 + origin[k] + 1]), s)))"""
    )
    found = judged.select("doc_id", "n", F.posexplode(per).alias("k", "s")).filter(F.col("s.c") >= SHARE * F.col("n"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return found.select("doc_id", named.alias("subject"), (F.col("s.c") / F.col("n")).alias("share"), (F.col("s.p") / F.col("s.c")).alias("posterior"))
