"""SQL building blocks for the counterparts (DuckDB dialect)."""

from __future__ import annotations

from catalog.fixtures import duck


def staged(source: str, *stages: str) -> str:
    """Nested selects, so that every stage is computed once."""
    sql = source
    for stage in stages:
        sql = f"(SELECT *, {stage} FROM {sql})"
    return sql


def lab(source: str, r: str, g: str, b: str, p: str) -> str:
    """``source`` with ``{p}l, {p}a, {p}b``."""
    def lin(c: str) -> str:
        return (
            f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92"
            f" ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
        )

    def f(t: str) -> str:
        return f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END"

    d = "::DOUBLE"
    return staged(
        source,
        f"{lin(r)} AS {p}lr, {lin(g)} AS {p}lg, {lin(b)} AS {p}lb",
        f"({p}lr * 0.4124564{d} + {p}lg * 0.3575761{d} + {p}lb * 0.1804375{d}) / 0.95047{d} AS {p}x,"
        f" ({p}lr * 0.2126729{d} + {p}lg * 0.7151522{d} + {p}lb * 0.0721750{d}) / 1.0{d} AS {p}y,"
        f" ({p}lr * 0.0193339{d} + {p}lg * 0.1191920{d} + {p}lb * 0.9503041{d}) / 1.08883{d} AS {p}z",
        f"{f(p + 'x')} AS {p}fx, {f(p + 'y')} AS {p}fy, {f(p + 'z')} AS {p}fz",
        f"116 * {p}fy - 16 AS {p}l, 500 * ({p}fx - {p}fy) AS {p}a, 200 * ({p}fy - {p}fz) AS {p}b",
    )


def both_labs(source: str) -> str:
    """Both sides of a slot pair in LAB (``k_`` and ``m_``)."""
    return lab(lab(source, "r1", "g1", "b1", "k_"), "r2", "g2", "b2", "m_")


def de94(source: str, p1: str = "k_", p2: str = "m_") -> str:
    a, b = f"({p1}a - {p2}a)", f"({p1}b - {p2}b)"
    return staged(
        source,
        f"sqrt({p1}a * {p1}a + {p1}b * {p1}b) AS c1_, sqrt({p2}a * {p2}a + {p2}b * {p2}b) AS c2_",
        f"greatest({a} * {a} + {b} * {b} - (c1_ - c2_) * (c1_ - c2_), 0) AS dh2_",
        f"sqrt(({p1}l - {p2}l) * ({p1}l - {p2}l) + pow((c1_ - c2_) / (1 + 0.045::DOUBLE * c1_), 2)"
        " + dh2_ / pow(1 + 0.015::DOUBLE * c1_, 2)) AS de",
    )


def de2000(source: str, p1: str = "k_", p2: str = "m_") -> str:
    l1, a1, b1, l2, a2, b2 = (f"{p}{c}" for p in (p1, p2) for c in "lab")
    d = "::DOUBLE"

    def hue(a: str, b: str) -> str:
        return (
            f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0{d} WHEN atan2({b}, {a}) < 0 "
            f"THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
        )

    return staged(
        source,
        f"pow((sqrt({a1} * {a1} + {b1} * {b1}) + sqrt({a2} * {a2} + {b2} * {b2})) / 2, 7) AS c7_",
        f"1 + 0.5{d} * (1 - sqrt(c7_ / (c7_ + pow(25.0{d}, 7)))) AS g_",
        f"{a1} * g_ AS x1_, {a2} * g_ AS x2_",
        f"sqrt(x1_ * x1_ + {b1} * {b1}) AS q1_, sqrt(x2_ * x2_ + {b2} * {b2}) AS q2_,"
        f" {hue('x1_', b1)} AS h1_, {hue('x2_', b2)} AS h2_",
        f"""CASE WHEN q1_ * q2_ = 0 THEN 0 WHEN h2_ - h1_ > 180 THEN h2_ - h1_ - 360
       WHEN h2_ - h1_ < -180 THEN h2_ - h1_ + 360 ELSE h2_ - h1_ END AS dh_,
  CASE WHEN q1_ * q2_ = 0 THEN h1_ + h2_ WHEN abs(h2_ - h1_) <= 180 THEN (h1_ + h2_) / 2
       WHEN h1_ + h2_ < 360 THEN (h1_ + h2_ + 360) / 2 ELSE (h1_ + h2_ - 360) / 2 END AS hm_,
  (q1_ + q2_) / 2 AS qm_, pow(({l1} + {l2}) / 2 - 50, 2) AS lm_""",
        f"""1 - 0.17{d} * cos(radians(hm_ - 30)) + 0.24{d} * cos(radians(2 * hm_))
    + 0.32{d} * cos(radians(3 * hm_ + 6)) - 0.20{d} * cos(radians(4 * hm_ - 63)) AS t_""",
        f"""({l2} - {l1}) / (1 + 0.015{d} * lm_ / sqrt(20 + lm_)) AS el_,
  (q2_ - q1_) / (1 + 0.045{d} * qm_) AS ec_,
  2 * sqrt(q1_ * q2_) * sin(radians(dh_ / 2)) / (1 + 0.015{d} * qm_ * t_) AS eh_,
  -2 * sqrt(pow(qm_, 7) / (pow(qm_, 7) + pow(25.0{d}, 7)))
     * sin(radians(60 * exp(-pow((hm_ - 275) / 25, 2)))) AS rt_""",
        "sqrt(greatest(el_ * el_ + ec_ * ec_ + eh_ * eh_ + rt_ * ec_ * eh_, 0)) AS de",
    )


STRICT = """CASE WHEN {d} <= 1 THEN 95 - 5 * {d} WHEN {d} <= 3 THEN 90 - 20 * ({d} - 1)
  WHEN {d} <= 6 THEN 50 - 10 * ({d} - 3) WHEN {d} <= 10 THEN 20 - 4 * ({d} - 6)
  ELSE greatest(0, 4 - 0.5::DOUBLE * ({d} - 10)) END"""
PERCEPTUAL = """CASE WHEN {d} <= 1 THEN 100 WHEN {d} <= 2 THEN 95 - 10 * ({d} - 1)
  WHEN {d} <= 5 THEN 85 - 15 * ({d} - 2) WHEN {d} <= 10 THEN 40 - 6 * ({d} - 5)
  WHEN {d} <= 20 THEN 10 - 0.8::DOUBLE * ({d} - 10) ELSE 0 END"""
LAB = """CASE WHEN {d} <= 2 THEN 100 - 5 * {d} WHEN {d} <= 10 THEN 90 - 7.5::DOUBLE * ({d} - 2)
  WHEN {d} <= 50 THEN 30 - 0.75::DOUBLE * ({d} - 10) ELSE 0 END"""


def hsv(source: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """``hue`` in degrees, ``sat`` and ``val`` in percent, ``h180``, ``s255``, ``dist``."""
    return staged(
        source,
        f"greatest({r}, {g}, {b}) AS mx_, greatest({r}, {g}, {b}) - least({r}, {g}, {b}) AS sp_,"
        f" ({r} + {g} + {b}) / 3.0::DOUBLE AS mean_",
        f"""CASE WHEN sp_ = 0 THEN 0.0::DOUBLE WHEN mx_ = {r} THEN ({g} - {b})::DOUBLE / sp_
       WHEN mx_ = {g} THEN ({b} - {r})::DOUBLE / sp_ + 2 ELSE ({r} - {g})::DOUBLE / sp_ + 4 END * 60 AS h0_,
  sqrt((({r} - mean_) * ({r} - mean_) + ({g} - mean_) * ({g} - mean_) + ({b} - mean_) * ({b} - mean_)) / 3.0::DOUBLE) AS sd_,
  CASE WHEN mx_ = 0 THEN 0.0::DOUBLE ELSE sp_ * 100.0::DOUBLE / mx_ END AS sat, mx_ * 100.0::DOUBLE / 255 AS val,
  CASE WHEN mx_ = 0 THEN 0 ELSE floor(sp_ * 255.0::DOUBLE / mx_ + 0.5::DOUBLE)::INT END AS s255""",
        "CASE WHEN h0_ < 0 THEN h0_ + 360 ELSE h0_ END AS hue, sat / 100 * 0.7::DOUBLE + sd_ / 255 * 0.3::DOUBLE AS dist",
        "(floor(hue / 2 + 0.5::DOUBLE)::INT % 180)::INT AS h180",
    )


FAMILY = """CASE WHEN s255 < 50 THEN 'grayscale' WHEN h180 < 15 OR h180 > 165 THEN 'red'
  WHEN h180 < 35 THEN 'orange' WHEN h180 < 75 THEN 'yellow' WHEN h180 < 105 THEN 'green'
  WHEN h180 < 135 THEN 'cyan' ELSE 'blue' END"""


def palette_ctes(pixels: str, n: int) -> str:
    """``pal``: top ``n`` quantised colours of each image with their share of those."""
    return f"""px AS ({duck(pixels)}),
hq AS (SELECT image_id, (r // 32) * 32 AS r, (g // 32) * 32 AS g, (b // 32) * 32 AS b, count(*) AS n
       FROM px GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS slot FROM hq),
pal AS (SELECT image_id, slot::INT AS slot, r, g, b,
               n::DOUBLE / sum(n) OVER (PARTITION BY image_id) AS weight FROM hr WHERE slot <= {n})"""


def slot_pairs(pairs: str, pal1: str, pal2: str) -> str:
    return f"""SELECT p.ref_id, p.cmp_id, a.slot AS s1, a.r AS r1, a.g AS g1, a.b AS b1, a.weight AS w1,
       b.slot AS s2, b.r AS r2, b.g AS g2, b.b AS b2, b.weight AS w2
FROM {pairs} p JOIN {pal1} a ON a.image_id = p.ref_id JOIN {pal2} b ON b.image_id = p.cmp_id"""


def knn_ctes(vectors: str, k: int, name: str = "nn", metric: str = "ip", ident: str = "image_id") -> str:
    """``{name}(ref_id, cmp_id, score, rank)``: exact neighbours, self left out."""
    score = (
        "round(list_dot_product(a.e, b.e), 12)"
        if metric == "ip"
        else "round(greatest(list_distance(a.e, b.e) * list_distance(a.e, b.e), 0), 12)"
    )
    order = "s DESC" if metric == "ip" else "s"
    return f"""{name}_v AS (SELECT {ident} AS id, embedding::DOUBLE[] AS e FROM {vectors} WHERE embedding IS NOT NULL),
{name}_s AS (SELECT a.id AS ref_id, b.id AS cmp_id, {score} AS s FROM {name}_v a, {name}_v b WHERE a.id <> b.id),
{name} AS (SELECT ref_id, cmp_id, round(s, 6) AS score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY {order}, cmp_id) AS rank FROM {name}_s) WHERE rank <= {k})"""
