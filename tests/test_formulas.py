"""Anchors of the row-wise formulas, and gaps."""

import pytest

from thermogrid.functions import formulas as M


def value(spark, text):
    return spark.range(1).select(M.column(text).cast("double").alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        (M.heat_index("20.0", "40.0"), 18, 22),
        (M.heat_index("35.0", "70.0"), 44, 62),
        (M.humidex("30.0", "25.0"), 40, 44),
        (M.wet_bulb("20.0", "50.0"), 12.7, 14.7),
        (M.wet_bulb("25.0", "100.0"), 24, 26),
        (M.bowen_ratio("100.0", "50.0"), 1.999, 2.001),
        (M.longwave_up("26.85", "1.0"), 459.0, 459.6),
        (M.lst_from_longwave(M.longwave_up("35.0", "0.96"), "0.96"), 34.999, 35.001),
        (M.fvc_square_then_clip("-0.1"), 0.999, 1.0),
        (M.fvc_clip_then_square("-0.1"), 0.0, 0.0),
        (M.work_loss("29.5"), 0.5, 0.5),
        (M.utci_category("46.0"), 0, 0),
        (M.utci_category("-50.0"), 9, 9),
        (M.eei_class("0.005"), 1, 1),
        (M.priority_class("80.0"), 4, 4),
    ],
)
def test_anchor(spark, text, low, high):
    assert low <= value(spark, text) <= high


@pytest.mark.parametrize("text", [M.clip("CAST(NULL AS DOUBLE)", 0.0, 1.0), M.ratio("1.0", "0.0"), M.heat_index("CAST(NULL AS DOUBLE)", "50.0")])
def test_gap(spark, text):
    assert value(spark, text) is None


@pytest.mark.parametrize("text", [M.eei_class("CAST(NULL AS DOUBLE)"), M.priority_class("CAST(NULL AS DOUBLE)"), M.utci_category("CAST(NULL AS DOUBLE)")])
def test_class_of_gap(spark, text):
    assert value(spark, text) == -1
