import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.functions import canonical_name, coerce_numeric, token_type

MISSING = {"", "na", "n/a", "nan", "null", "none", "?"}
POS = {"inf", "+inf", "infinity", "+infinity"}
NEG = {"-inf", "-infinity"}


def py_token(cell: str) -> str:
    s = cell.strip(" \t\n\r\f\v")
    lo = s.lower()
    if lo in MISSING:
        return "missing"
    if lo in POS or lo in NEG:
        return "infinite"
    digit = dot = False
    for i, ch in enumerate(s):
        if ch.isdigit() and ch.isascii():
            digit = True
        elif ch in "+-":
            if i != 0 and s[i - 1] not in "eE":
                return "string"
        elif ch in ".eE":
            dot = True
        else:
            return "string"
    if not digit:
        return "string"
    return "float" if dot else "integer"


cells = st.text(alphabet="0123456789.eE+-xa ", max_size=8) | st.sampled_from(
    ["", " NaN ", "inf", "-Infinity", "1.2.3", "1e5", "+1", "1+", "--1", "e", ".", "1d", "?"])


@settings(max_examples=150, deadline=None)
@given(st.lists(cells, min_size=1, max_size=40))
def test_token_type_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [r.t for r in df.select(token_type("c").alias("t")).collect()]
    assert got == [py_token(v) for v in values]


def test_coerce_numeric(spark):
    vals = ["12", " 1.5 ", "1e5", "Infinity", "-inf", "nan", "x", "1d", "1_000", "", "1.2.3", "+.5", "--5"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r.v for r in df.select(coerce_numeric("c").alias("v")).collect()]
    assert got[:3] == [12.0, 1.5, 1e5]
    assert got[3] == math.inf and got[4] == -math.inf and math.isnan(got[5])
    assert got[6:11] == [None, None, None, None, None]
    assert got[11] == 0.5 and got[12] is None


def test_canonical_names(spark):
    want = {"  Idle Max ": "idle_max", "bytes/sec": "bytes_per_sec", "A--b__C": "a_b_c", "\t": "unnamed", "/": "per",
            "-x/y-": "x_per_y", "": "unnamed", "9 lives!": "9_lives"}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.c for r in df.select("n", canonical_name("n").alias("c")).collect()} == want
