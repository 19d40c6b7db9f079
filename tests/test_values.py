import random

import pytest

from larkspur.functions.text import tokenize
from larkspur.functions.values import auto_interval, default_span, interval_ms, round4, time_bound
from larkspur.operators.search import listed
from larkspur.operators.stats import Agg, _nearest_ranks
from larkspur.plans.filters import compare, index, phrase, word


def test_tokens():
    assert tokenize("PUT /cart/v2 192.168.0.7") == ["put", "cart", "v2", "192.168.0.7", "192", "168", "0", "7"]
    assert tokenize("disk-full alarm") == ["disk-full", "disk", "full", "alarm"]
    assert tokenize("x.y r2.5") == ["x", "y", "r2.5", "r2", "5"]
    assert tokenize("-q_ --") == ["-q_", "q", "--"]
    assert tokenize("") == []


def test_filters_carry_indexes_and_highlights():
    f = word("Error*") & ~word("debug") & word("api", "service") & compare("status", ">", 5) & word("x", "source") & phrase("two words")
    assert f.highlights == ("error", "api", "two words") and (f | word("a*b")).highlights == f.highlights
    assert (index("web*") & ~index("api") & word("error")).indexes == ("web*", "api")


def test_aggregates():
    names = [Agg(*x).name for x in (("count",), ("sum", "x"), ("mean", "y"), ("median", "z"), ("max", "a", "most"))]
    assert names == ["count", "sum(x)", "avg(y)", "p50(z)", "most"]
    for bad in (("earliest", "x"), ("stdev", "x"), ("sum",)):
        with pytest.raises(ValueError):
            Agg(*bad)


def test_times():
    assert interval_ms("5m") == 300_000 and interval_ms("250", bare=True) == 250
    with pytest.raises(ValueError):
        interval_ms("5")
    assert time_bound("now", 7) == 7 and time_bound("-1h", 3_600_000) == 0 and time_bound("1970-01-01T00:00:01Z", 0) == 1000
    assert time_bound("yesterday", 0) is None
    assert default_span(None, 5) == 3_600_000 and default_span(0, 3_600_000) == 60_000


@pytest.mark.parametrize(
    ("seconds", "span"), [(0, 10), (60, 10), (599, 10), (900, 20), (1500, 30), (3599, 60), (3600, 60), (7300, 120), (86400, 1440), (864000, 14400)]
)
def test_auto_interval(seconds, span):
    assert auto_interval(0, seconds * 1000) == span * 1000
    assert auto_interval(None, 5) == 60_000


def test_listed_partitions():
    assert listed("default/web/2024-01-01, _ops/app/2024-01-02,") == [("default", "web", "2024-01-01"), ("_ops", "app", "2024-01-02")]
    with pytest.raises(ValueError):
        listed("default/web")


def test_ranks_among_many_values_of_one_size(spark):
    """Values that differ in late digits only, ties, signs, zeros and infinities: nearest ranks as if ordered as a whole."""
    random.seed(9)
    groups = {
        "near": [1 + i * 1e-13 for i in range(3000)], "ties": [5.0] * 500 + [5.0000001] * 500, "one": [-3.25],
        "mixed": [random.choice([-1, 1]) * 10 ** random.uniform(-300, 300) for _ in range(2000)] + [0.0, float("inf"), -float("inf")] * 20,
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("one", None)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "__k0 string, __x double")
    shares = {f"q{i}": i / 20 for i in range(21)}
    got = {r["__k0"]: r for r in _nearest_ranks(df, 1, shares).collect()}
    rank = lambda xs, q: sorted(xs)[int((len(xs) - 1) * q + 0.5)]
    rounded = df.sparkSession.createDataFrame([(k, n, rank(xs, q)) for k, xs in groups.items() for n, q in shares.items()], "k string, n string, x double")
    for k, n, x in rounded.select("k", "n", round4(rounded["x"])).collect():
        assert got[k][n] == x, (k, n)
    whole = _nearest_ranks(df.drop("__k0"), 0, {"p": 0.5}).first()["p"]
    assert whole == pytest.approx(rank([x for xs in groups.values() for x in xs], 0.5), abs=1e-4)
