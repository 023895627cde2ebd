from graphloom.operators import profile


def test_orphans_match_as_text_and_ignore_nulls(spark):
    users = spark.createDataFrame([(1,), (2,)], "id int")
    orders = spark.createDataFrame([(10, "1", "x"), (20, "999", "x"), (30, " ", "x"), (40, None, "x"), (20, "999", "x"), (50, " 2 ", "x")], "id int, user_id string, __0 string").drop("__0")
    out = profile.orphans(orders, ["user_id"], users, ["id"]).collect()
    assert [(r.id, r.user_id) for r in out] == [(20, "999"), (20, "999")]
    (s,) = profile.orphan_summary({"c": (orders, ["user_id"], users, ["id"])}).collect()
    assert (s.rows_scanned, s.references, s.orphans, s.orphan_values) == (6, 4, 2, 1)


def test_composite_orphans_use_simple_match(spark):
    parent = spark.createDataFrame([(1, 2)], "a int, b int")
    child = spark.createDataFrame([(1, 2), (1, 3), (1, None), (None, None)], "x int, y int")
    assert [tuple(r) for r in profile.orphans(child, ["x", "y"], parent, ["a", "b"]).collect()] == [(1, 3)]


def test_overlap(spark):
    users, orders = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([("1",), ("2",), ("99",), (None,), ("1",)], "u string")
    assert tuple(profile.value_overlap(orders, "u", users, "id").first()) == (3, 2, 2 / 3)
    assert profile.value_overlap(orders.limit(0), "u", users, "id").first()["overlap"] is None


def test_ratios_dependencies_and_delimiters(spark):
    df = spark.createDataFrame([("a", 1, "x,y"), ("a", 1, "x;y"), ("b", 2, "x"), ("b", 3, None), (None, 4, "")], "k string, v int, t string")
    ratios = {r.column_name: (r.filled, r.distinct_values, r.ratio) for r in profile.distinct_ratios(df, ["k", "v"]).collect()}
    assert ratios == {"k": (4, 2, 0.5), "v": (5, 4, 0.8)}
    fd = {(r.determinant, r.dependent): (r.groups, r.strength) for r in profile.fd_strengths(df, [("k", "v"), ("v", "k")]).collect()}
    assert fd == {("k", "v"): (2, 0.5), ("v", "k"): (4, 0.75)}
    rates = {(r.column_name, r.delimiter): r.rate for r in profile.delimiter_rates(df, ["t"]).collect()}
    assert rates == {("t", ","): 0.25, ("t", ";"): 0.25, ("t", "|"): 0.0, ("t", "\t"): 0.0}


def test_key_candidates_and_samples(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, "b")], "a int, b int, c string")
    keys = lambda d: {r[0] for r in profile.key_candidates(d, d.columns).collect()}
    assert keys(df) == {"a"} and keys(df.limit(0)) == {"a", "b", "c"}
    assert profile.sample_values(df, "b", 5).count() == 1
