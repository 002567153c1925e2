import math

import pytest

from lumora.functions import clocks, durations, fingerprint, literals, numbers
from lumora.functions.errors import QueryError
from lumora.functions.patterns import java_pattern


@pytest.mark.parametrize("text, ns", [("0", 0), ("5m", 300 * 10**9), ("1h30m", 5400 * 10**9), ("1y2w3d4h5m6s7ms", 33_019_506_007 * 10**6), ("100ms", 10**8)])
def test_durations(text, ns):
    assert durations.duration_ns(text) == ns


@pytest.mark.parametrize("text", ["", "5", "1m1h", "1h1h", "-1s", "1.5h", "1x", "h", " 5m", "300y"])
def test_durations_rejected(text):
    with pytest.raises(QueryError):
        durations.duration_ns(text)


@pytest.mark.parametrize("text, ns", [("1.5h", 5400 * 10**9), ("150ns", 150), ("1d", 86_400 * 10**9), ("2µs", 2000), ("1m1h", 3660 * 10**9)])
def test_log_ranges(text, ns):
    assert durations.log_range_ns(text) == ns


@pytest.mark.parametrize("text", ["", "0s", "0", "-5m", "x"])
def test_log_ranges_rejected(text):
    with pytest.raises(QueryError):
        durations.log_range_ns(text)


def test_float_literals():
    assert numbers.parse_float("0x1p4") == 16 and numbers.parse_float(".5") == 0.5 and math.isinf(numbers.parse_float("-Inf"))
    for bad in ("", "1_0", "0x1", "1e", "+nan", "1e999", " 1", "--1"):
        with pytest.raises(QueryError):
            numbers.parse_float(bad)


def test_division_follows_ieee():
    assert numbers.divide(1, 0) == math.inf and numbers.divide(-1, 0.0) == -math.inf and numbers.divide(1, -0.0) == -math.inf
    assert math.isnan(numbers.divide(0, 0))


@pytest.mark.parametrize("value, text", [(99.0, "99"), (2.5, "2.5"), (1e21, "1" + "0" * 21), (1e-7, "0.0000001"), (0.1 + 0.2, "0.30000000000000004"), (math.inf, "+Inf"), (-math.inf, "-Inf"), (math.nan, "NaN"), (-0.0, "-0")])
def test_value_format(value, text):
    assert numbers.format_value(value) == text


@pytest.mark.parametrize("text, ns", [("1700000000", 1_700_000_000 * 10**9), ("17000000000", 17_000_000_000), ("1700000000.5", 1_700_000_000_500_000_000), ("-1234567890", -1_234_567_890), ("2023-11-14T22:13:20Z", 1_700_000_000 * 10**9), ("2023-11-14T23:13:20.5+01:00", 1_700_000_000_500_000_000)])
def test_log_times(text, ns):
    assert clocks.log_time_ns(text) == ns


@pytest.mark.parametrize("text", ["", "x", "9999999999.5", "9999999999", "2023-13-01T00:00:00Z", "99999999999999999999"])
def test_log_times_rejected(text):
    with pytest.raises(QueryError):
        clocks.log_time_ns(text)


def test_metric_times():
    assert clocks.metric_time_ms("1.0005") == 1001 and clocks.metric_time_ms("-0.0005") == -1 and clocks.metric_step_ms("1m") == 60_000
    for bad in ("nan", "9223372036854776", "x"):
        with pytest.raises(QueryError):
            clocks.metric_time_ms(bad)


def test_log_window_and_step():
    now = 10**18
    assert clocks.log_window(now) == (now - clocks.HOUR_NS, now)
    assert clocks.log_window(now, since="5m", end=str(now + 10**12)) == (now - 300 * 10**9, now + 10**12)
    with pytest.raises(QueryError):
        clocks.log_window(now, start=str(now), end=str(now - 1))
    assert clocks.log_step_ns(None, 0, 3600 * 10**9) == 14 * 10**9 and clocks.log_step_ns("0.5", 0, 10**9) == 5 * 10**8
    for bad in ("0", "-1", "x"):
        with pytest.raises(QueryError):
            clocks.log_step_ns(bad, 0, 10**9)
    with pytest.raises(QueryError):
        clocks.log_step_ns("1ms", 0, 3600 * 10**9)
    assert clocks.log_limit("") == 100 and clocks.log_backward("FORWARD") is False
    for bad in ("0", "-1", "1.5", "x"):
        with pytest.raises(QueryError):
            clocks.log_limit(bad)


def test_fingerprint_golden():
    assert fingerprint.fingerprint({"service": "api", "__name__": "http_requests"}) == 9_696_857_623_413_696_903
    assert fingerprint.signed(2**64 - 1) == -1


def test_literals():
    assert literals.take_literal('"a\\n\\x41\\u00e9" rest', 0) == ("a\nAé", 15)
    assert literals.take_literal("`a\\n`", 0)[0] == "a\\n"
    for bad in ('"\\d"', '"\\\'"', '"open', "x", '"\\ud800"', '"\\777"'):
        with pytest.raises(QueryError):
            literals.take_literal(bad, 0)
    assert literals.render_labels({"b": 'x"\n', "a": "é\x01"}) == '{a="é\\x01", b="x\\"\\n"}'


@pytest.mark.parametrize("bad", ["(", ")", "[a", "a**", "(?=x)", "(?<!x)", "\\1", "a{1001}", "a{2,1}", "*a", "\\C", "a++", "(?>x)", "\\"])
def test_patterns_rejected(bad):
    with pytest.raises(QueryError):
        java_pattern(bad)


def test_patterns_match_like_re2(spark):
    import duckdb

    lines = ["a.b", "a\rb", "end\n", "end", "x\x0by", "a b", "K", "[x]", "a&&b", "ABC", "tab\there", "", "é", "aab", "q{1", "dot.", "foo\nbar"]
    patterns = ["a.b", "end$", "x\\sy", "\\s", "(?i)k", "[[]x", "[a&&b]+$", "(?i)abc", "^$", "[[:alpha:]]+", "(?P<n_x>a)b", "a{2}", "\\d|\\Qdot.\\E", "(?m)foo$", "[^\\s]+ ", "\\pL", "(?s)o.b", "q{1", "(?U)a+?b", "[]x]"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    for p in patterns:
        ours = [r[0] for r in frame.selectExpr("line").select(frame.line.rlike(java_pattern(p))).collect()]
        theirs = [duckdb.execute("SELECT regexp_matches(?, ?)", [x, p]).fetchone()[0] for x in lines]
        assert ours == theirs, p
