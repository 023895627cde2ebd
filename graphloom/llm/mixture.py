"""Mixing sources to target weights (problem 7) by cube-method balanced sampling.

Every document of a source gets the same expected number of uses; its whole part is used outright
and the fraction is an inclusion probability. The flight of the cube method moves the fractional
probabilities along null-space directions of the balancing constraints (tokens and documents)
until they are 0 or 1. Flights run in blocks of bounded size; what each block leaves undecided (at
most as many documents as there are constraints) is gathered into new blocks, level by level,
until one small landing problem per source remains.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.runtime import cut, spread

#: Where the public tokenizer's vocabulary file lies; a parameter of count_tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one flight, at most about so many.
BLOCK = 4096
_NEAR = 1e-9


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of each row; a NULL text has 0 tokens. Whole texts are tokenized."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [0 if text is None else len(encoding.encode_ordinary(text)) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": tokens})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def flight(weights: list[float], chances: list[float], pick: random.Random) -> list[float]:
    """Chances after the flight: all but at most two are 0 or 1; the sum of the chances and the sum
    of weight times chance are kept (up to rounding).

    Three undecided units at a time span a null-space of dimension one of the two constraints; the
    chances move along it, one way or the other at random so that each keeps its expectation.
    """
    chances = list(chances)
    waiting = [i for i, c in enumerate(chances) if _NEAR < c < 1 - _NEAR]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            return chances
        a, b, c = (weights[i] for i in active)
        direction = [b - c, c - a, a - b]  # orthogonal to (1, 1, 1) and to the weights
        if not any(direction):
            direction = [1.0, -1.0, 0.0]
        up = down = math.inf
        for i, d in zip(active, direction):
            if d > 0:
                up, down = min(up, (1 - chances[i]) / d), min(down, chances[i] / d)
            elif d < 0:
                up, down = min(up, chances[i] / -d), min(down, (1 - chances[i]) / -d)
        step = up if pick.random() * (up + down) < down else -down
        for i, d in zip(active, direction):
            chances[i] = min(1.0, max(0.0, chances[i] + step * d))
        active = [i for i in active if _NEAR < chances[i] < 1 - _NEAR]


def land(weights: list[float], chances: list[float], pick: random.Random) -> list[float]:
    """Whole chances: the flight is ended with the document constraint dropped (pairs move against
    each other by weight), and the last unit is drawn by its chance."""
    chances = flight(weights, chances, pick)
    while len(left := [i for i, c in enumerate(chances) if _NEAR < c < 1 - _NEAR]) >= 2:
        i, j = left[:2]
        d = [weights[j], -weights[i]] if weights[i] or weights[j] else [1.0, -1.0]
        up = down = math.inf
        for k, x in zip((i, j), d):
            if x > 0:
                up, down = min(up, (1 - chances[k]) / x), min(down, chances[k] / x)
            elif x < 0:
                up, down = min(up, chances[k] / -x), min(down, (1 - chances[k]) / -x)
        step = up if pick.random() * (up + down) < down else -down
        for k, x in zip((i, j), d):
            chances[k] = min(1.0, max(0.0, chances[k] + step * x))
    return [1.0 if (c >= 1 - _NEAR or (c > _NEAR and pick.random() < c)) else 0.0 for c in chances]


def _round(undecided: DataFrame, level: int, block: int, last: bool, seed: int) -> DataFrame:
    """One level: flights (at the last level landings) in blocks of about `block` documents."""
    number = F.when(F.lit(last), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.ceil(F.col("of_source") / block)))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        pick = random.Random(f"{seed}/{level}/{pdf['source'].iloc[0]}/{pdf['block'].iloc[0]}")
        order = list(range(len(pdf)))
        pick.shuffle(order)
        weights, chances = pdf["tokens"].astype(float).tolist(), pdf["chance"].tolist()
        moved = (land if last else flight)([weights[i] for i in order], [chances[i] for i in order], pick)
        for i, c in zip(order, moved):
            chances[i] = c
        return pdf.assign(chance=chances)[["doc_id", "source", "tokens", "whole", "chance"]]

    return (
        undecided.withColumn("block", number)
        .groupBy("source", "block")
        .applyInPandas(fly, "doc_id bigint, source string, tokens bigint, whole bigint, chance double")
    )


def plan_shares(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, weight, max_repeats, documents, source_tokens, wanted, rate) per target source.

    Without total_tokens the total is the largest at which each target source with tokens reaches
    its weight within its repeats. rate is the expected number of uses of each document of the
    source; a source that cannot fill its share has the rate max_repeats.
    """
    sizes = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("source_tokens"))
    goal = targets.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    both = goal.join(sizes, "source", "left").fillna(0, ["documents", "source_tokens"])
    if total_tokens is None:
        fill = F.when((F.col("source_tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0), F.col("source_tokens") * F.col("max_repeats") / F.col("weight"))
        total_tokens = both.agg(F.floor(F.min(fill)).alias("total")).first()["total"] or 0
    wanted = F.col("weight") * total_tokens
    rate = F.when(F.col("source_tokens") > 0, F.least(wanted / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("wanted", wanted).withColumn("rate", rate)


def use_counts(counted: DataFrame, shares: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, uses) of every document of `counted` (doc_id, source, tokens) for
    the rates of plan_shares. Documents of no target source, or of a NULL one, have 0 uses.

    The tokens used of a source differ from rate times its tokens by less than a document or two,
    and no document is used more than max_repeats times. Rows that repeat a doc_id count each.
    The result depends on the seed and the documents only.
    """
    rates = shares.select("source", "rate", F.col("documents").alias("of_source"))
    # The table of sources is small beside the documents; adaptive execution picks the join.
    rated = counted.join(rates, "source", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    whole = F.floor(F.col("rate") + _NEAR)
    start = cut(
        rated.select("doc_id", "source", "tokens", whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("chance"), F.coalesce("of_source", F.lit(0)).alias("of_source"))
    )
    open_ = (F.col("chance") > _NEAR) & (F.col("chance") < 1 - _NEAR)
    columns = ["doc_id", "source", "tokens", "whole", "chance"]
    done = [start.where(~open_).select(columns)]
    undecided, level = start.where(open_), 0
    largest = undecided.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0
    while largest:
        last = largest <= block
        moved = cut(_round(undecided, level, block, last, seed))
        done.append(moved.where(~open_))
        if last:
            break
        rest = moved.where(open_)
        # Counts per source: one row for each target source.
        of_source = rest.groupBy("source").agg(F.count(F.lit(1)).alias("of_source"))
        largest = of_source.agg(F.max("of_source").alias("n")).first()["n"] or 0
        undecided, level = rest.join(of_source, "source"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.when(F.col("chance") >= 0.5, 1).otherwise(0)).alias("uses"))


def reached_shares(uses: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, documents, source_tokens, wanted_tokens, used_tokens,
    largest_use, share, share_of_planned, shortfall) per target source.

    share is of all tokens used, share_of_planned of the tokens that all sources together should
    give (they differ where a source is missing or too small), and shortfall the part of the
    weight that is not reached, by the planned total."""
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("largest_use"))
    total = uses.agg(F.sum(F.col("tokens") * F.col("uses")).alias("total")).first()["total"]
    planned = shares.agg(F.sum("wanted").alias("planned")).first()["planned"]
    both = shares.join(used, "source", "left").fillna(0, ["used_tokens", "largest_use"])
    share = F.col("used_tokens") / total if total else F.lit(0.0)
    of_planned = F.col("used_tokens") / planned if planned else F.lit(0.0)
    missing = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.col("used_tokens") / F.nullif(F.col("wanted"), F.lit(0.0)), F.lit(0.0))) * F.col("weight")
    return both.select(
        "source", "weight", "max_repeats", "documents", "source_tokens", F.round("wanted").cast("bigint").alias("wanted_tokens"), "used_tokens", "largest_use",
        share.alias("share"), of_planned.alias("share_of_planned"), missing.alias("shortfall"),
    )


def share_checks(uses: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, documents, uses_within_cap, tokens_as_planned, shortfall_told) per
    target source: what holds for every mixture, whatever was drawn.

    No document is used more than max_repeats times, nor unlike another of its source by more than
    one use; the tokens used differ from what the rate gives by less than two documents; and the
    report tells a shortfall where the source cannot fill its weight."""
    seen = uses.groupBy("source").agg(F.max("uses").alias("most"), F.min("uses").alias("least"), F.max("tokens").alias("largest"))
    report = reached_shares(uses, shares).join(shares.select("source", "rate"), "source").join(seen, "source", "left")
    cap = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("most") - F.col("least") <= 1), F.lit(True))
    planned = F.coalesce(F.abs(F.col("used_tokens") - F.col("rate") * F.col("source_tokens")) <= 2 * F.col("largest"), F.col("used_tokens") == 0)
    short = F.col("rate") * F.col("source_tokens") < F.col("wanted_tokens") - 1
    told = ~short | (F.col("shortfall") > 0)
    return report.select("source", "weight", "max_repeats", "documents", cap.alias("uses_within_cap"), planned.alias("tokens_as_planned"), told.alias("shortfall_told"))
