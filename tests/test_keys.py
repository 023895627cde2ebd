import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import keys


def plain(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() or c in keys.KEY_MARKS else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def test_escape_matches_the_rule_and_is_injective(spark):
    found = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=12))
    def collect(text):
        found.append(text)

    collect()
    texts = sorted(set(found) | {"", " ", "%", "a/b", "50%25", "~", "+", "*", "2024-01-01 00:00:00+00", "Łódź/ß", "日本", "\x7f", "a\tb"})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keys.escape(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: plain(t) for t in texts}
    assert len({r.k for r in rows}) == len(texts)


def test_parts_join_and_null_parts_give_no_key(spark):
    df = spark.createDataFrame([(1, "a b"), (0, ""), (None, "x"), (2, None)], "a bigint, b string")
    out = df.select(keys.key([(df.a, T.LongType()), (df.b, T.StringType())], "-").alias("k")).collect()
    assert [r.k for r in out] == ["1-a%20b", "0-", None, None]


def test_timestamps_have_six_digits_or_none(spark):
    stamps = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 500000), None]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    out = [r[0] for r in df.select(keys.as_text(df.t, df.schema["t"].dataType)).collect()]
    assert out == [str(stamps[0]), str(stamps[1]), None]


def test_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t x\n\xa0",)], "t string")
    assert df.select(keys.strip(df.t)).first()[0] == "x"


def test_plain_types_need_no_escape(spark):
    df = spark.createDataFrame([(-5, True, datetime.date(2024, 1, 2))], "i bigint, b boolean, d date")
    for f in df.schema.fields:
        plain_part, escaped = df.select(keys.key_part(df[f.name], f.dataType), keys.escape(keys.as_text(df[f.name], f.dataType))).first()
        assert plain_part == escaped
