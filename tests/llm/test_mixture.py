import random
import statistics

import pytest

from graphloom.llm import mixture


def test_flight_keeps_totals_and_leaves_two():
    pick = random.Random(1)
    weights = [pick.randrange(1, 400) for _ in range(500)]
    chances = [0.3] * 500
    out = mixture.flight(weights, chances, pick)
    assert sum(1e-9 < c < 1 - 1e-9 for c in out) <= 2
    assert sum(out) == pytest.approx(150, abs=1e-6) and sum(w * c for w, c in zip(weights, out)) == pytest.approx(0.3 * sum(weights), abs=1e-3)


@pytest.mark.parametrize("weights", [[5] * 30, [0] * 30, [0, 5] * 15, [7], [1, 9], [3, 3, 4]])
def test_land_decides_all(weights):
    out = mixture.land(weights, [0.4] * len(weights), random.Random(2))
    assert set(out) <= {0.0, 1.0} and abs(sum(w * c for w, c in zip(weights, out)) - 0.4 * sum(weights)) <= 2 * max(weights)


def test_every_unit_keeps_its_chance():
    weights = [1, 5, 9, 30, 2, 8]
    hits = [statistics.mean(xs) for xs in zip(*[mixture.land(weights, [0.35] * 6, random.Random(s)) for s in range(4000)])]
    assert all(abs(h - 0.35) < 0.03 for h in hits)


def counted(spark, sizes, seed=1):
    pick = random.Random(seed)
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, source, pick.randrange(0, 300)))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), rows


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]


@pytest.mark.parametrize("block", [4096, 64, 7])
def test_shares_by_any_block_size(spark, block):
    docs, rows = counted(spark, {"a": 900, "b": 150, "c": 40, None: 5, "other": 30})
    shares = mixture.plan_shares(docs, spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int"))
    uses = mixture.use_counts(docs, shares, block=block)
    got = uses.collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    most = {s: m for s, _, m in TARGETS}
    assert all(0 <= r.uses <= most.get(r.source, 0) for r in got)
    plan = {r.source: r for r in shares.collect()}
    for s in ("a", "b", "c"):
        used = sum(r.uses * r.tokens for r in got if r.source == s)
        assert abs(used - plan[s].wanted) <= 600
        whole = int(plan[s].rate)
        assert {r.uses for r in got if r.source == s} <= {whole, whole + 1}
    report = {r.source: r for r in mixture.reached_shares(uses, shares).collect()}
    assert report["none"].shortfall == pytest.approx(0.1) and report["none"].used_tokens == 0 and report["a"].share == pytest.approx(0.5 / 0.9, abs=0.02)
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    assert all(r.uses_within_cap and r.tokens_as_planned and r.shortfall_told for r in mixture.share_checks(uses, shares).collect())
    planned = sum(r.wanted for r in plan.values())
    assert report["a"].share_of_planned == pytest.approx(report["a"].used_tokens / planned) and report["a"].share_of_planned == pytest.approx(0.5, abs=0.02)
    spoilt = uses.withColumn("uses", uses.uses + 5)
    assert not any(r.uses_within_cap for r in mixture.share_checks(spoilt, shares).collect() if r.source != "none")
    again = mixture.use_counts(docs.repartition(7), shares, block=block).collect()
    assert {r.doc_id: r.uses for r in got} == {r.doc_id: r.uses for r in again}


def test_a_given_total_and_shortfalls(spark):
    docs, _ = counted(spark, {"a": 50, "b": 5})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    size = {r.source: r.source_tokens for r in mixture.plan_shares(docs, targets).collect()}
    shares = mixture.plan_shares(docs, targets, total_tokens=10 * size["b"])
    report = {r.source: r for r in mixture.reached_shares(mixture.use_counts(docs, shares), shares).collect()}
    assert report["b"].used_tokens == 2 * size["b"] and report["b"].shortfall == pytest.approx(0.3, abs=1e-9) and report["b"].largest_use == 2


def test_empty_tables(spark):
    docs, _ = counted(spark, {"a": 3})
    none = spark.createDataFrame([], "source string, weight double, max_repeats int")
    targets = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int")
    assert {r.uses for r in mixture.use_counts(docs, mixture.plan_shares(docs, none)).collect()} == {0}
    empty = docs.limit(0)
    shares = mixture.plan_shares(empty, targets)
    assert mixture.use_counts(empty, shares).count() == 0 and mixture.reached_shares(mixture.use_counts(empty, shares), shares).count() == 4


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "Hello world"), (2, None, None), (3, "a", ""), (4, "a", "<|endoftext|> 日本 " * 3000)], "doc_id bigint, source string, text string").selectExpr("*", "1 as tokens")
    out = {r.doc_id: r.tokens for r in mixture.count_tokens(df).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 9000
