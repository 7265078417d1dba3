"""Layer geometry against the formulas worked out in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from citetide.operators import layers, running
from citetide.plans import streams

# e has no values at all; at x = 13 nothing has
SERIES = {
    "a": [0, 4, 1, 0, 6],
    "b": [3, 2, 0, 0, 5],
    "c": [0, 0, 7, 0, 2],
    "d": [9, 1, 1, 0, 1],
    "e": [0, 0, 0, 0, 0],
}
XS = list(range(10, 15))
ONSET = ["b", "d", "a", "c", "e"]


@pytest.fixture(params=["one chunk", "many chunks"])
def table(spark, request, monkeypatch):
    if request.param == "many chunks":
        monkeypatch.setattr(running, "CHUNK", 2)
    rows = [(s, x, v) for s, vs in SERIES.items() for x, v in zip(XS, vs)]
    return spark.createDataFrame(rows, "series string, x int, value bigint")


@pytest.fixture
def ordered(table):
    return layers.order_series(table)


def by_cell(df, *columns):
    return {(r["series"], r["x"]): tuple(r[c] for c in columns) for r in df.collect()}


def by_x(df):
    return [r["baseline"] for r in df.orderBy("x").collect()]


def columns_in_onset_order():
    return [[SERIES[s][i] for s in ONSET] for i in range(len(XS))]


def test_densify(spark, values):
    sparse = spark.createDataFrame(
        [("a", 3, 1), ("a", 3, 2), ("b", 5, 4), ("c", 1, 1)], "k string, year int, n bigint"
    )
    dense = layers.densify(sparse, "k", "year", "n")
    filled = {("a", 3): 3, ("b", 5): 4, ("c", 1): 1}
    assert values(dense) == sorted(((s, x, filled.get((s, x), 0)) for s in "abc" for x in range(1, 6)), key=repr)
    assert layers.densify(sparse.limit(0), "k", "year", "n").count() == 0


def test_onset_order(table):
    order = {r.series: r.position for r in layers.onset_order(table).collect()}
    assert [s for s, _ in sorted(order.items(), key=lambda kv: kv[1])] == ONSET


def test_simple_baselines(ordered):
    totals = [sum(column) for column in columns_in_onset_order()]
    assert by_x(layers.baseline(ordered, "symmetric")) == pytest.approx([-t / 2 for t in totals])
    assert by_x(layers.baseline(ordered, "zero")) == [0.0] * 5
    with pytest.raises(ValueError):
        layers.baseline(ordered, "other")


def test_wiggle_baseline(ordered):
    previous, level, expected = [0] * 5, 0.0, []
    for column in columns_in_onset_order():
        moved = 0.0
        for i, v in enumerate(column):
            below = sum(column[j] - previous[j] for j in range(i))
            moved += (0.5 * (v - previous[i]) + below) * v
        level -= moved / sum(column) if sum(column) else 0.0
        expected.append(level)
        previous = column
    assert by_x(layers.baseline(ordered, "wiggle")) == pytest.approx(expected)


def test_stack(ordered):
    found = by_cell(layers.stack(ordered, layers.baseline(ordered, "symmetric"), yoffset=2.0), "lower", "upper")
    for i, x in enumerate(XS):
        level = 2.0 - sum(SERIES[s][i] for s in ONSET) / 2
        for s in ONSET:
            assert found[s, x] == pytest.approx((level, level + SERIES[s][i]))
            level += SERIES[s][i]


def alternating():
    bounds = {}
    for i, x in enumerate(XS):
        up = down = 0
        for n, s in enumerate(ONSET):
            v = SERIES[s][i]
            if n % 2 == 0:
                bounds[s, x] = (up, up + v)
                up += v
            else:
                bounds[s, x] = (-down - v, -down)
                down += v
    return bounds


def test_alternating_bounds(ordered):
    assert by_cell(layers.alternate_bounds(ordered), "lower", "upper") == alternating()


def test_single_series(spark):
    one = spark.createDataFrame([("a", x, x) for x in XS], "series string, x int, value bigint")
    found = by_cell(streams.alternating_layers(one, "zero"), "lower", "upper")
    assert found == {("a", x): (0.0, float(x)) for x in XS}


def test_alternating_baselines(ordered):
    bounds = layers.alternate_bounds(ordered)
    expected = alternating()
    lows = [min(expected[s, x][0] for s in ONSET) for x in XS]
    highs = [max(expected[s, x][1] for s in ONSET) for x in XS]
    middle = [(lo + hi) / 2 for lo, hi in zip(lows, highs)]
    assert by_x(layers.alternate_baseline(bounds, "symmetric")) == pytest.approx(middle)
    assert by_x(layers.alternate_baseline(bounds, "positive")) == pytest.approx(lows)
    assert by_x(layers.alternate_baseline(bounds, "zero")) == [0.0] * 5
    signed = [[v if n % 2 == 0 else -v for n, v in enumerate(column)] for column in columns_in_onset_order()]
    level, wiggle = 0.0, []
    for i, column in enumerate(signed):
        height = highs[i] - lows[i]
        if i and height:
            change = [v - p for v, p in zip(column, signed[i - 1])]
            level -= sum((change[n] / 2 + sum(change[:n])) * v for n, v in enumerate(column)) / height
        wiggle.append(level)
    assert by_x(layers.alternate_baseline(bounds, "wiggle")) == pytest.approx(wiggle)
    outlines = by_cell(layers.layer_outlines(bounds, layers.alternate_baseline(bounds, "wiggle")), "lower", "upper")
    for i, x in enumerate(XS):
        for s in ONSET:
            assert outlines[s, x] == pytest.approx(tuple(b - wiggle[i] for b in expected[s, x]))


def test_heights_add_up_to_the_values(table):
    stacked = streams.stacked_layers(table, "wiggle")
    height = stacked.agg(F.sum(F.col("upper") - F.col("lower"))).first()[0]
    assert height == pytest.approx(sum(map(sum, SERIES.values())))


@pytest.mark.parametrize("how", ["wiggle", "symmetric"])
def test_doubles_do_not_depend_on_the_layout(spark, monkeypatch, how):
    """Values that lose bits when added in another order give the same doubles in all partitionings and chunks."""
    rng = random.Random(1)
    rows = [(f"s{s:02d}", x, rng.choice([0.1, 1e-7, 1234567.891, 1 / 3, 0.0]) * rng.random()) for s in range(25) for x in range(30)]
    found = set()
    for partitions, chunk in [(1, 4096), (3, 4096), (7, 2), (5, 3), (2, 1)]:
        monkeypatch.setattr(running, "CHUNK", chunk)
        rng.shuffle(rows)
        table = spark.createDataFrame(rows, "series string, x int, value double").repartition(partitions)
        stacked = streams.stacked_layers(table, how).orderBy("series", "x").select("lower", "upper").collect()
        turned = streams.alternating_layers(table, how).orderBy("series", "x").select("lower", "upper").collect()
        found.add((tuple(map(tuple, stacked)), tuple(map(tuple, turned))))
    assert len(found) == 1
