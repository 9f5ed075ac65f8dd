"""Mixing sources to target weights (problem 8).

The largest mix is taken that no source limits: with T tokens in all, a source
of weight w gives w * T, so T is the least of (tokens x most repeats) / w. Each
document of a source is then used the same expected number of times r. Its
whole part is certain; of the fraction p a balanced sample is drawn by the cube
method: the vector of inclusion probabilities moves within the null space of
the constraints "number of documents" and "number of tokens" until each
component is 0 or 1. Both totals stay exact during the flight; only the last
two or three documents of a source have to be landed, by the choice that
misses the token total least.

What landing misses is about the size of a document, so documents above a
thousandth of what the source is to give are decided before the flight, each
with its probability as far as the token total can still be met; the others'
probability is then set so that the total fits again.

Scale: the flight runs in blocks of bounded size, keyed by source and hash, so
a source with half of all rows is many tasks. A block leaves at most two
undecided documents; those form the blocks of the next level, and so on until a
source has one block. Sums over blocks are exact, so the whole is balanced, too.
Between levels the small table (id, source, tokens, p) is cut by a checkpoint.

Defined results: documents without tokens (null or empty text) are never used;
sources that are not listed, or null, get no share; listed sources without
tokens get none, and the other weights are scaled up to a sum of 1; without any
tokens the result is empty. A weight of 0 or null gives no share.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokenizer import DEFAULT_VOCABULARY, count_column
from spanloom.session import cut_lineage
from spanloom.sources.tables import spread

BLOCK = 4000  # documents of a block, on average
LARGE = 1e-3  # of a source's tokens in the mix; larger documents are decided before the flight
LARGEST = 1e-5  # of a source's tokens: no document below is large, so that the large ones are at most 100,000 per source
EDGE = 1e-9


def flight(p: list[float], tokens: list[int], seed: int) -> list[float]:
    """Cube flight under the constraints sum(p) and sum(p * tokens): at most two components stay fractional.

    Three undecided components always have a direction that keeps both sums;
    the step goes to the boundary on one of its sides, drawn so that each
    component keeps its expectation.
    """
    rng = random.Random(seed)
    out = list(p)
    hold: list[int] = []
    for i in range(len(out)):
        if EDGE < out[i] < 1 - EDGE:
            hold.append(i)
        while len(hold) == 3:
            a, b, c = hold
            u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - out[k]) / d if d > 0 else out[k] / -d for k, d in zip(hold, u) if d)
            down = min(out[k] / d if d > 0 else (1 - out[k]) / -d for k, d in zip(hold, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for k, d in zip(hold, u):
                x = out[k] + step * d
                out[k] = 0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x
            hold = [k for k in hold if 0.0 < out[k] < 1.0]
    return out


def land(p: list[float], tokens: list[int]) -> list[float]:
    """Decide the few fractional components by the choice that misses the token total least."""
    open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    goal = sum(p[i] * tokens[i] for i in open_)
    count = sum(p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(tokens[i] for k, i in enumerate(open_) if m >> k & 1) - goal), abs(bin(m).count("1") - count)), default=0)
    out = list(p)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def decide_large(tokens: list[int], p: float, goal: float, small: float, seed: int) -> list[int]:
    """0 or 1 for each large document: with probability ``p`` as long as the small ones' tokens can make up ``goal``.

    The largest are decided first, while there is most to make up with.
    """
    rng = random.Random(seed)
    out, chosen, left = [0] * len(tokens), 0.0, float(sum(tokens))
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i], i)):
        left -= tokens[i]
        fits = chosen + tokens[i] <= goal
        needed = chosen + left + small < goal
        if fits and (needed or rng.random() < p):
            out[i] = 1
            chosen += tokens[i]
    return out


def _flyer(last: set[str], level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight of one block; sources in ``last`` have a single block and are landed."""

    def fly(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        tokens = part["tokens"].tolist()
        p = flight(part["p"].tolist(), tokens, seed=int(part["doc_id"].iloc[0]) * 31 + level)
        part["p"] = land(p, tokens) if part["source"].iloc[0] in last else p
        return part[["doc_id", "source", "tokens", "base", "p"]]

    return fly


def sizes(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source and tokens; written once, as counting is the costly part."""
    named = docs.select("doc_id", "source", "text").filter("source IS NOT NULL AND text IS NOT NULL")
    counted = spread(named, "doc_id").select("doc_id", "source", count_column(F.col("text"), path).alias("tokens"))
    return cut_lineage(counted).filter("tokens > 0")  # filtered afterwards: a filter would move below and count twice


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used, from (doc_id, source, tokens) and (source, weight, max_repeats)."""
    spark = sized.sparkSession
    schema = "doc_id long, source string, tokens int, copies int"
    goal = {r.source: (float(r.weight or 0), int(r.max_repeats or 0)) for r in targets.select("source", "weight", "max_repeats").filter("source IS NOT NULL").collect()}
    wanted = sized.filter(F.col("source").isin([s for s, (w, m) in goal.items() if w > 0 and m > 0] or [""]))
    have = {r.source: (r.n, r.t) for r in wanted.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    if not have:
        return spark.createDataFrame([], schema)
    weights = sum(goal[s][0] for s in have)
    total = min(t * goal[s][1] / (goal[s][0] / weights) for s, (_, t) in have.items())
    rate = {s: min(total * goal[s][0] / weights / t, goal[s][1]) for s, (_, t) in have.items()}
    whole = {s: int(math.floor(r + EDGE)) for s, r in rate.items()}
    rest = {s: max(0.0, r - whole[s]) for s, r in rate.items()}

    def by_source(values: dict):
        return F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, v)])[F.col("source")]

    open_ = wanted.withColumn("base", by_source(whole)).withColumn("p", by_source({s: float(v) for s, v in rest.items()}))
    done = open_.filter(f"p <= {EDGE}").withColumn("p", F.lit(0.0)).select("doc_id", "source", "tokens", "base", "p")
    state = open_.filter(f"p > {EDGE}").select("doc_id", "source", "tokens", "base", "p")
    left = {s: n for s, (n, _) in have.items() if rest[s] > EDGE}
    level = 0
    row = "doc_id long, source string, tokens int, base int, p double"

    if left:
        due = {s: rest[s] * have[s][1] for s in left}
        bound = {s: max(LARGE * rate[s] * have[s][1], LARGEST * have[s][1]) for s in left}
        is_large = F.col("tokens") > by_source(bound)
        sizes_of = {r.source: float(r.t) for r in state.filter(is_large).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}

        def decide(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("doc_id")
            s = part["source"].iloc[0]
            part["p"] = [float(x) for x in decide_large(part["tokens"].tolist(), rest[s], due[s], have[s][1] - sizes_of[s], seed=int(part["doc_id"].iloc[0]))]
            return part[["doc_id", "source", "tokens", "base", "p"]]

        if sizes_of:
            large = cut_lineage(state.filter(is_large).groupBy("source").applyInPandas(decide, row))
            taken = {r.source: float(r.t) for r in large.filter("p = 1").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
            done = done.unionByName(large)
            small = {s: have[s][1] - sizes_of.get(s, 0.0) for s in left}
            again = {s: min(1.0, max(0.0, (due[s] - taken.get(s, 0.0)) / small[s])) if small[s] > 0 else 0.0 for s in left}
            state = state.filter(~is_large).withColumn("p", by_source(again))
            fixed = (F.col("p") <= EDGE) | (F.col("p") >= 1 - EDGE)
            done = done.unionByName(state.filter(fixed).withColumn("p", F.round("p")))
            state = state.filter(~fixed)
            left = {r.source: r["count"] for r in state.groupBy("source").count().collect()}

    while left:
        blocks = {s: max(1, -(-n // BLOCK)) for s, n in left.items()}
        last = {s for s, b in blocks.items() if b == 1}

        block = F.pmod(F.xxhash64("doc_id", F.lit(level)), by_source(blocks).cast("long"))
        flown = cut_lineage(state.select("doc_id", "source", "tokens", "base", "p", block.alias("block")).groupBy("source", "block").applyInPandas(_flyer(last, level), row))
        done = done.unionByName(flown.filter("p = 0 OR p = 1"))
        state = flown.filter("p > 0 AND p < 1")
        # Each block leaves at most two documents, so the levels shrink by about BLOCK / 2.
        left = {r.source: r["count"] for r in state.groupBy("source").count().collect()}
        level += 1
    used = done.select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).cast("int").alias("copies"))
    return used.filter("copies > 0")


def report(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: weight wanted, documents, uses, tokens and the actual share in percent."""
    per = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    rows = targets.select("source", "weight", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    share = F.coalesce(F.round(100.0 * F.col("tokens") / F.col("all_tokens"), 4), F.lit(0.0)).alias("actual_share")
    return rows.select("source", "weight", "max_repeats", zero("documents"), zero("uses"), zero("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), share)
