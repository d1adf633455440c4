from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitquarry.functions import flags
from bitquarry.functions.codecs import array_deltas, varint_decode, varint_encode, varint_length
from bitquarry.functions.flags import Mask, parse_flag


@pytest.mark.parametrize(("text", "value"), [("0x4", 4), ("0X400", 1024), ("0b100", 4), (" 4 ", 4), ("65535", 65535), ("0B1", 1)])
def test_literals(text, value):
    assert parse_flag(text) == value


@pytest.mark.parametrize("text", ["65536", "0x10000", "0xZZ", "0b2", "-1", "", " ", "0x", "1_0", "+1"])
def test_bad_literals(text):
    with pytest.raises(ValueError):
        parse_flag(text)


def test_lists_and_options():
    assert flags.parse_flags("0x4,16") == [4, 16]
    assert Mask.of("0x1", 0, ["unmapped", "--non-duplicate", "mapped"]) == Mask(5, 0x404)
    with pytest.raises(ValueError):
        Mask.of(options=["nothing"])
    assert len(flags.INCLUDE) == 12 and len(flags.EXCLUDE) == 7


@given(st.integers(0, 65535), st.integers(0, 65535), st.integers(0, 65535))
def test_normal_form(flag, r, f):
    m = Mask(r, f)
    plain = (flag & r) == r and (flag & f) == 0
    assert m.matches(flag) == plain
    if not m.is_empty:
        assert ((flag & (r | f)) == r) == plain
    else:
        assert not plain


def test_columns(spark):
    df = spark.createDataFrame([(0,), (1,), (0x8001,), (0xFFF,), (0x1000,)], "flag int")
    rows = {r["flag"]: r for r in df.select("flag", flags.labels().alias("l"), flags.hex_flag().alias("h"), flags.binary_flag().alias("b"), flags.set_bits().alias("s")).collect()}
    assert rows[0]["l"] == "none" and rows[0x1000]["l"] == "none" and rows[0x8001]["l"] == "paired"
    assert rows[0]["h"] == "0x000" and rows[0x8001]["h"] == "0x8001" and rows[0]["b"] == "0" * 12 and rows[0x1000]["b"] == "1" + "0" * 12
    assert [x["bit"] for x in rows[0xFFF]["s"]] == [1 << i for i in range(12)]
    assert flags.flag_bits(spark).count() == 12
    assert df.filter(Mask(0x8000, 0).column()).count() == 1
    assert "Filter" not in Mask().apply(df)._jdf.queryExecution().optimizedPlan().toString()


def test_rendering(spark):
    df = spark.range(1)
    ages = [(30, "30s ago"), (90, "1.5m ago"), (5400, "1.5h ago"), (129600, "1.5d ago"), (-5400, "in 1.5h")]
    for gone, text in ages:
        assert df.select(flags.age(F.lit(1_000_000 - gone), F.lit(1_000_000))).first()[0] == text
    assert [df.select(flags.memory(F.lit(x))).first()[0] for x in (1023.4, 1536.0)] == ["1023MB", "1.5GB"]
    assert [df.select(flags.threads_label(F.lit(n), "t")).first()[0] for n in (0, 4)] == ["auto", "4t"]


@given(st.lists(st.integers(0, (1 << 64) - 1)))
def test_varints(values):
    assert varint_decode(varint_encode(values)) == values


def test_bad_varints():
    for data in (b"\x80", b"\xff" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            varint_decode(data)


def test_varint_lengths(spark):
    values = [0, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 62)]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(varint_length("v")).collect()
    assert [r[0] for r in got] == [len(varint_encode([v])) for v in values]
    assert spark.sql("select array(bigint(3), 5, 4) as a").select(array_deltas("a")).first()[0] == [2, -1]
    assert spark.sql("select array(bigint(3)) as a").select(array_deltas("a")).first()[0] == []
