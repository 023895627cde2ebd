import random

from graphloom.operators import temporal as t

LOG = "_key string, op string, seq bigint, ts bigint, v string, shard string"


def versions(spark, rows, config=None):
    return t.versions_from_log(spark.createDataFrame([(*r, "s") for r in rows], LOG).repartition(3), config)


def plain(rows):
    out = []
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[2])
        n = 0
        for i, r in enumerate(mine):
            if r[1] != "DELETE":
                out.append((f"{k}-{n}", r[3], mine[i + 1][3] if i + 1 < len(mine) else t.NEVER, r[4]))
                n += 1
    return sorted(out)


def test_versions_with_a_hot_key(spark):
    pick = random.Random(5)
    rows = [("hot" if pick.random() < 0.5 else f"k{pick.randrange(9)}", pick.choice(["INSERT", "REPLACE", "REPLACE", "DELETE"]), i, i * 1_000_000, f"v{i}") for i in range(150)]
    pick.shuffle(rows)
    got = versions(spark, rows + rows[:30])
    assert sorted((r._key, r.created, r.expired, r.v) for r in got.collect()) == plain(rows)


def test_lifecycle_and_questions(spark):
    s = 1_000_000
    rows = [("a", "INSERT", 1, 10 * s, "x"), ("a", "REPLACE", 2, 20 * s, "y"), ("a", "DELETE", 3, 30 * s, None), ("a", "INSERT", 4, 40 * s, "z"), ("b", "INSERT", 5, 15 * s, "q"), (None, "INSERT", 6, 1, "no")]
    v = versions(spark, rows)
    keys = lambda df: sorted(r._key for r in df.collect())
    assert keys(v) == ["a-0", "a-1", "a-2", "b-0"]
    assert {r._key: r.ttlExpireAt for r in v.collect()} == {"a-0": 20 + t.RETAIN_SECONDS, "a-1": 30 + t.RETAIN_SECONDS, "a-2": None, "b-0": None}
    assert keys(t.snapshot_at(v, 20 * s)) == ["a-1", "b-0"] and keys(t.snapshot_at(v, 35 * s)) == ["b-0"] and keys(t.snapshot_at(v, 5 * s)) == []
    assert keys(t.overlapping(v, 0, 10 * s)) == ["a-0"] and keys(t.overlapping(v, 30 * s, 39 * s)) == ["a-1", "b-0"]
    assert {(r._key, r.created_in, r.expired_in) for r in t.changed_between(v, 10 * s, 20 * s).collect()} == {("a-0", False, True), ("a-1", True, False), ("b-0", True, False)}
    assert keys(t.current(v)) == ["a-2", "b-0"]
    edges = t.version_edges(v, "user")
    assert [r._key for r in t.history(v, edges, "user", "a").collect()] == ["a-2", "a-1", "a-0"]
    assert {(r._from, r._to) for r in edges.where("_key like 'a-0-%'").collect()} == {("userProxyIn/a", "user/a-0"), ("user/a-0", "userProxyOut/a")}
    assert keys(t.proxies(v)) == ["a", "b"]
    assert keys(t.aged(v, 25 + t.RETAIN_SECONDS)) == ["a-1", "a-2", "b-0"]
    moments = spark.createDataFrame([(12 * s,), (20 * s,), (20 * s,), (99 * s,)], "t bigint")
    assert sorted((r.t // s, r._key) for r in t.snapshots_at(v, moments, width=7 * s).collect()) == [(12, "a-0"), (20, "a-1"), (20, "b-0"), (99, "a-2"), (99, "b-0")]


def test_many_moments_give_the_same(spark, monkeypatch):
    pick = random.Random(6)
    rows = [(f"k{pick.randrange(4)}", pick.choice(["INSERT", "REPLACE", "DELETE"]), i, i * 10 + pick.randrange(9), "v") for i in range(60)]
    v = versions(spark, rows)
    moments = spark.createDataFrame([(pick.randrange(700),) for _ in range(50)] + [(None,)], "t bigint")
    found = lambda: sorted((r.t, r._key) for r in t.snapshots_at(v, moments, width=37).collect())
    want = sorted((m, r._key) for r in v.collect() for m in {x.t for x in moments.collect()} if m is not None and r.created <= m < r.expired)
    assert found() == want and want
    monkeypatch.setattr(t, "MOMENTS_MOST", 3)
    assert found() == want
    assert t.snapshots_at(v, moments.limit(0)).count() == 0


def test_shards_exclusion_and_empty(spark):
    config = t.TemporalConfig(smart_field="shard", exclude_collections=("logs",))
    out = versions(spark, [("a", "INSERT", 1, 1, "x")], config).first()
    assert (out._key, out._proxy) == ("s:a-0", "s:a")
    assert config.applies("users") and not config.applies("logs")
    assert versions(spark, []).count() == 0


def test_proxified_edges(spark):
    df = spark.createDataFrame([("1_2", "a/1", "b/2", "l")], "_key string, _from string, _to string, _label string")
    assert tuple(t.proxify(df).first()) == ("1_2", "aProxyOut/1", "bProxyIn/2", "l")
