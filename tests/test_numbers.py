import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from metricspark.functions.numbers import number_text, python_number_text, text_to_double


@pytest.mark.parametrize(
    "x, text",
    [
        (6.0, "6"),
        (0.25, "0.25"),
        (999999.0, "999999"),
        (1e6, "1e+06"),
        (1234567.5, "1.2345675e+06"),
        (1e21, "1e+21"),
        (0.0001, "0.0001"),
        (0.00001, "1e-05"),
        (-2.5e-7, "-2.5e-07"),
        (0.0, "0"),
        (1e100, "1e+100"),
        (32768.0, "32768"),
        (math.inf, "+Inf"),
        (-math.inf, "-Inf"),
        (math.nan, "NaN"),
    ],
)
def test_constants(x, text):
    assert python_number_text(x) == text


def test_columns_agree_with_constants(spark):
    rnd = random.Random(7)
    xs = [round(rnd.uniform(-(10**e), 10**e), d) for e in range(1, 9) for d in range(7) for _ in range(20)]
    # of seventeen digits the last depends on the Java version, so bit patterns are cut to fewer
    bits = [struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] for _ in range(2000)]
    xs += [float(f"{x:.{d}g}") for x in bits for d in (3, 10, 16)] + [0.0, 1.0, -1.0, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != python_number_text(r.x)] == []


def test_null_stays_null(spark):
    assert spark.range(1).select(number_text(F.lit(None).cast("double"))).first()[0] is None


@pytest.mark.parametrize(
    "text, value",
    [
        ("5", 5.0),
        ("-2.5e3", -2500.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("inf", math.inf),
        ("-Infinity", -math.inf),
        ("5d", None),
        (" 5", None),
        ("", None),
        ("abc", None),
        ("1e999", None),
        ("0x10", None),
        (None, None),
    ],
)
def test_text_to_double(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(text_to_double(F.col("t"))).first()[0]
    assert got == value


def test_text_to_nan(spark):
    got = spark.createDataFrame([("nan",)], "t string").select(text_to_double(F.col("t"))).first()[0]
    assert math.isnan(got)
