"""The ranker's boosted trees against Spark ML's, and against sums made row by row."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.operators import boosting, models

INPUTS = ["steady", "hour", "rare", "value"]


@pytest.fixture(scope="module")
def rows(spark):
    """4,800 rows of 200 groups of 24 hours; ``rare`` is mostly zero, ``value`` has 200 values."""
    rng = np.random.default_rng(5)
    made = []
    for group in range(200):
        steady = float(rng.integers(0, 30))
        for hour in range(24):
            rare = float(rng.integers(1, 9)) if rng.random() < 0.1 else 0.0
            value = float(rng.integers(0, 200)) / 7
            spend = 3 * rare + (hour in (8, 17)) * steady + np.sqrt(value) + rng.normal()
            made.append((group, float(hour), steady, rare, value, float(spend)))
    frame = spark.createDataFrame(made, "id long, hour double, steady double, rare double, value double, spend double")
    return frame.coalesce(3).cache()


def test_same_trees_as_spark_ml(rows):
    theirs = models.boosted_trees(INPUTS, "spend", 45, step=0.05, depth=4).fit(rows).transform(rows)
    own = boosting.fit(rows, INPUTS, "spend", 45, step=0.05, depth=4).predict(rows, ["id", "hour"], "own")
    both = theirs.join(own, ["id", "hour"])
    assert both.count() == 4800
    assert both.filter(F.abs(F.col("own") - F.col("predicted")) > 1e-9).limit(5).collect() == []


def test_sums_of_a_block_are_those_of_its_rows():
    rng = np.random.default_rng(6)
    n = 3000
    bins = np.array([np.repeat(rng.integers(0, 5, n // 24), 24), rng.integers(0, 256, n), rng.integers(0, 9, n) * (rng.random(n) < 0.2)], np.uint8)
    residuals = rng.normal(size=n)
    tree = boosting.unsplit(3)
    tree.feature[:3], tree.bin[:3] = [1, 0, 2], [100, 2, 0]
    for level, slots in ((0, np.array([0])), (2, np.array([-1, 0, 1, -1]))):
        right = bins[1] > 100
        node = 2 * right + np.where(right, bins[2] > 0, bins[0] > 2) if level else np.zeros(n, int)
        expected = np.zeros((2, 3, slots.max() + 1, 256))
        for row in range(n):
            slot = slots[node[row]]
            for f in range(3 if slot >= 0 else 0):
                expected[:, f, slot, bins[f, row]] += 1, residuals[row]
        for layout in (boosting.Layout([-1, -1, -1], []), boosting.Layout([-1, -1, 0], [0]), boosting.Layout([3, -1, 0], [])):
            got = boosting.block_sums(bins, residuals, tree, level, slots, layout)
            assert (got[0] == expected[0]).all()
            assert np.abs(got[1] - expected[1]).max() < 1e-9


def test_cut_points_of_many_values_split_off_the_zeros(spark):
    frame = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id") + 0.5).otherwise(0.0).alias("x"))
    (cuts,) = boosting.cut_points(frame, ["x"])
    assert cuts[0] == 0 and len(cuts) == 255
    held = np.bincount(np.searchsorted(cuts, np.arange(0, 20000, 10) + 0.5), minlength=256)
    assert held[0] == 0 and held[1:].max() <= 12


def test_rows_without_anything_to_split(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    fitted = boosting.fit(frame, ["x"], "y", 3, step=0.05, depth=4)
    assert [r["predicted"] for r in fitted.predict(frame, ["y"]).collect()] == [3.0, 3.0]


def panel_like(seed, lines=400):
    """Bins of zones and days by hour: two inputs stay for a line's 24 hours, two are mostly bin 0; one line repeats an hour."""
    rng = np.random.default_rng(seed)
    n = lines * 24
    active = rng.random(n) < 0.15
    hour = np.tile(np.arange(24), lines)
    hour[5:7] = 5
    bins = np.array([hour, *(np.repeat(rng.integers(0, top, lines), 24) for top in (7, 255)), *(active * rng.integers(0, top, n) for top in (9, 200))], np.uint8)
    return bins, rng.normal(size=n) + active


def test_silent_hours_are_held_and_summed_by_line():
    layout = boosting.Layout([-1, -1, -1, 0, 0], [1, 2], *boosting._across(*_counted(panel_like(8)[0])))
    assert layout.across == 0 and layout.columns == tuple(range(24))
    bins, residuals = panel_like(8)
    block = boosting.packed(layout, (bins, residuals))
    assert block.grid.counts.sum() + len(block.rows[1]) == bins.shape[1] and len(block.rows[1]) < 0.2 * bins.shape[1]
    assert block.grid.counts.max() == 2
    tree = boosting.unsplit(4)
    tree.feature[:9], tree.bin[:9] = [3, 0, 2, 1, 4, 2, 0, 0, 0], [0, 11, 100, 3, 0, 50, 6, 255, 20]
    tree.value[:] = np.random.default_rng(9).normal(size=16)
    plain = boosting.Layout(layout.frequent, layout.steady)
    for level, slots in ((0, [0]), (1, [0, -1]), (1, [-1, 0]), (2, [0, 1, -1, 2]), (3, [0, -1, 1, -1, 2, -1, 3, -1]), (3, [-1, 0, -1, 1, -1, 2, -1, 3])):
        slots = np.array(slots)
        expected = boosting.block_sums(*boosting._less([tree], (bins, residuals)), tree, level, slots, plain)
        got = boosting.grid_sums(boosting._advance([tree], layout, block), tree, level, slots, layout)
        assert (got[0] == expected[0]).all()
        assert np.abs(got[1] - expected[1]).max() < 1e-9
    strange = bins.copy()
    strange[0, 30] = 77  # an hour that the fit has not seen
    assert np.abs(boosting.predictions(strange, [tree] * 3, layout) - 3 * tree.predict(strange)).max() < 1e-12


def _counted(bins):
    return np.array([np.bincount(values, minlength=256) for values in bins]), [-1, -1, -1, 0, 0], [1, 2]


def test_lines_are_cut_before_a_count_overflows():
    bins = np.zeros((3, 1000), np.uint8)
    block = boosting.packed(boosting.Layout([-1, -1, 0], [1], 0, (0,)), (bins, np.ones(1000)))
    assert block.grid.counts.sum() == 1000 and block.grid.sums.sum() == 1000


@pytest.mark.parametrize("files", [True, False])
def test_fits_of_silent_hours_are_those_of_spark_ml(spark, monkeypatch, files):
    """With residuals in files and cached by Spark; nothing is left in the shared folder."""
    bins, spend = panel_like(10, 200)
    names = ["hour", "dow", "past", "lag", "recent"]
    made = [(n, *map(float, column), float(y)) for n, (column, y) in enumerate(zip(bins.T, spend + 2 * (bins[3] > 2) + (bins[0] == 8) * bins[1], strict=True))]
    frame = spark.createDataFrame(made, ", ".join(["id long", *(f"{n} double" for n in names), "spend double"])).coalesce(2).cache()
    shared, kinds = boosting.shared_files(spark), []
    if not files:
        monkeypatch.setattr(boosting, "shared_files", lambda spark: None)
    layout_of = boosting._layout
    monkeypatch.setattr(boosting, "_layout", lambda rows: kinds.append(layout_of(rows)) or kinds[-1])
    own = boosting.fit(frame, names, "spend", 45, step=0.05, depth=4).predict(frame, ["id"], "own")
    theirs = models.boosted_trees(names, "spend", 45, step=0.05, depth=4).fit(frame).transform(frame)
    both = theirs.join(own, "id")
    assert both.count() == 4800
    assert both.filter(F.abs(F.col("own") - F.col("predicted")) > 1e-9).limit(5).collect() == []
    assert kinds[0].across == 0 and set(kinds[0].steady) == {1, 2}
    assert shared and not [name for name in os.listdir(shared) if name.startswith("residuals-")]
