"""Golden values and edge rows of the expressions."""

import pytest
from pyspark.sql import functions as F

from marklens.functions import color as C
from marklens.functions import scoring as S
from marklens.functions import text as T
from marklens.functions import vector as V
from marklens.functions.jaro import jaro_winkler_series


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "rgb, lab",
    [
        ((255, 0, 0), (53.2408, 80.0925, 67.2032)),
        ((0, 255, 0), (87.7347, -86.1827, 83.1793)),
        ((0, 0, 255), (32.297, 79.1875, -107.8602)),
        ((128, 128, 128), (53.585, 0, 0)),
        ((255, 255, 255), (100, 0, 0)),
    ],
)
def test_lab(spark, rgb, lab):
    row = C.with_lab(spark.createDataFrame([rgb], "r int, g int, b int")).first()
    assert (row.lab_l, row.lab_a, row.lab_b) == pytest.approx(lab, abs=2e-3)


@pytest.mark.parametrize(
    "first, second, expected",
    [
        ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425),
        ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615),
        ((50, 2.5, 0), (50, 0, -2.5), 4.3065),
        ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
        ((50, 0, 0), (50, 0, 0), 0.0),
    ],
)
def test_delta_e2000(spark, first, second, expected):
    rows = [tuple(float(x) for x in (*first, *second))]
    df = spark.createDataFrame(rows, "xl double, xa double, xb double, yl double, ya double, yb double")
    assert C.with_delta_e2000(df, "x", "y").first().delta_e == pytest.approx(expected, abs=1e-4)


def test_curves(spark):
    cases = [
        (C.strict_curve, {0: 95, 1: 90, 3: 50, 6: 20, 10: 4, 18: 0, 99: 0}),
        (C.perceptual_curve, {0: 100, 1: 100, 2: 85, 5: 40, 10: 10, 20: 2, 21: 0}),
        (C.lab_curve, {0: 100, 2: 90, 10: 30, 50: 0, 60: 0}),
    ]
    for curve, points in cases:
        for d, expected in points.items():
            assert value(spark, curve(F.lit(float(d)))) == pytest.approx(expected), (curve, d)


def test_fusion_rules(spark):
    def final(rule, image, text):
        return value(spark, rule(F.lit(float(image)), F.lit(float(text))))

    assert final(S.final_strict, 75, 29) == pytest.approx(0.7 * 75 + 0.3 * 29)
    assert final(S.final_strict, 75, 30) == pytest.approx(52.5)
    assert final(S.final_strict, 29, 75) == pytest.approx(0.3 * 29 + 0.7 * 75)
    assert final(S.final_strict, 20, 20) == pytest.approx(20)
    assert final(S.final_indexed, 61, 0) == 61

    def visual(image, text, a, b):
        return value(spark, S.final_visual_text(F.lit(image), F.lit(text), F.lit(a), F.lit(b)))

    assert visual(40.0, 90.0, " ", "x") == 40
    assert visual(40.0, 75.0, "y", "x") == pytest.approx(57.5)
    assert visual(40.0, 76.0, "y", "x") == pytest.approx(0.8 * 76 + 8)


def test_text_expressions(spark):
    def clean(text):
        return value(spark, T.clean_short(F.lit(text)))

    assert clean(None) == ""
    assert clean("  ''  ") == ""
    assert clean("THE TEXT IN THE IMAGE IS: Nike ") == "Nike"
    assert clean("The text in the image reads: The text in the image is: A") == "A"
    assert value(spark, T.clean_long(F.lit("Image text: The text shown is: A"))) == "The text shown is: A"
    assert value(spark, T.containment_similarity(F.lit("nike"), F.lit("nike air"))) == pytest.approx(92.5)
    assert value(spark, T.containment_similarity(F.lit(""), F.lit("x"))) == 0
    assert value(spark, T.levenshtein_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx((1 - 3 / 7) * 100)
    assert value(spark, T.common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert value(spark, T.common_suffix(F.lit("abcd"), F.lit("xxcd"))) == 2
    assert value(spark, T.char_overlap(F.lit("aab"), F.lit("abc"))) == pytest.approx(200 / 3)
    assert value(spark, T.normal_path(F.lit("/a//b/./c/../d/"))) == "/a/b/d"
    assert value(spark, T.base_name(F.lit("C:\\x\\y.png"))) == "y.png"
    assert value(spark, T.proprietor_name(F.lit("Ann Lee Trading as Shop"))) == "Ann Lee"
    assert value(spark, T.proprietor_name(F.lit("A AND B AND C"))) == "A, B, C"


def test_jaro_winkler_golden():
    import pandas as pd

    pairs = [("MARTHA", "MARHTA", 0.961111), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.813333), ("", "a", 0.0), (None, "a", 0.0), ("same", "same", 1.0)]
    left, right, expected = zip(*pairs)
    got = jaro_winkler_series(pd.Series(left), pd.Series(right))
    assert got.tolist() == pytest.approx(expected, abs=1e-6)


def test_vector_expressions(spark):
    a = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, V.l2_norm(a)) == 5
    assert value(spark, V.cosine(a, zero)) == 0
    assert value(spark, V.normalised(zero, V.l2_norm(zero))) == [0, 0]
    assert value(spark, V.fit_length(a, 4)) == [3, 4, 0, 0]
    assert value(spark, V.fit_length(a, 1)) == [3]
    assert value(spark, V.sorted_value_distance(a, zero)) == 3.5


def test_color_family(spark):
    # the bounds are on the 0..179 hue scale: 15, 35, 75, 105, 135
    cases = {
        (128, 128, 128): "grayscale",
        (255, 0, 0): "red",
        (255, 255, 0): "orange",
        (128, 255, 0): "yellow",
        (0, 255, 255): "green",
        (0, 0, 255): "cyan",
        (255, 0, 255): "blue",
    }
    for rgb, family in cases.items():
        assert value(spark, C.color_family(*[F.lit(x) for x in rgb])) == family
