"""The whole pipelines as queries: raw rooms to balanced rooms, and raw rooms to scaled features with their split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.operators import copula
from roomflow.plans import stages
from roomflow.plans.profile_queries import _CLEAN, _FEATURES, _NAMES
from roomflow.plans.registry import query
from roomflow.plans.tables import rooms


def _inside(source: str, column: str, factor: float, group: str | None = None) -> str:
    """Rows within quartiles and ``factor`` times their distance; groups under five rows have no bounds."""
    by, join, few = (f"{group}, ", f"USING ({group})", "n < 5 OR ") if group else ("", "ON true", "")
    q1, q3 = f"quantile_cont({column}, 0.25)", f"quantile_cont({column}, 0.75)"
    return f"SELECT s.* FROM {source} s JOIN (SELECT {by}greatest(0, {q1} - {factor} * ({q3} - {q1})) AS lo, {q3} + {factor} * ({q3} - {q1}) AS hi, count(*) AS n FROM {source} {'GROUP BY ' + group if group else ''}) b {join} WHERE {few}{column} BETWEEN lo AND hi"


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def _quantile_sql(u: str) -> str:
    """The normal quantile of a share."""
    near = lambda x: f"{_poly(f'sqrt(-2 * ln({x}))', copula.QUANTILE_C)} / {_poly(f'sqrt(-2 * ln({x}))', copula.QUANTILE_D)}"
    q, r = f"({u} - 0.5)", f"(({u} - 0.5) * ({u} - 0.5))"
    return f"CASE WHEN {u} < {copula.TAIL} THEN {near(u)} WHEN {u} > 1 - {copula.TAIL} THEN -({near(f'(1 - {u})')}) ELSE {q} * {_poly(r, copula.QUANTILE_A)} / {_poly(r, copula.QUANTILE_B)} END"


def _share_sql(z: str) -> str:
    """The share below a score."""
    t = f"(1 / (1 + {copula.DISTRIBUTION_P} * abs({z})))"
    above = f"exp(-{z} * {z} / 2) / {copula.ROOT_2PI} * {t} * {_poly(t, copula.DISTRIBUTION_B)}"
    return f"CASE WHEN {z} >= 0 THEN 1 - {above} ELSE {above} END"


def _value_sql(column: str, u: str) -> str:
    return f"(SELECT room_class, draw, v.{column} FROM shares s JOIN (SELECT room_class, {column}, at_{column} AS nth FROM ranks) v USING (room_class) WHERE nth = least(n, floor({u} * n)::bigint + 1))"


@query("F5 Q1 Q2 Q6 Q7 U4", f"""
    WITH {_CLEAN}, placed AS (SELECT row_id, hotel_name, room_class, price, area, people FROM clean WHERE location IS NOT NULL AND location <> 'Unknown' AND area <= 120),
    sized AS ({_inside('placed', 'area', 0.8)}), h AS ({_inside('(SELECT row_id, hotel_name, room_class, price, area, people FROM sized)', 'price', 0.8, 'room_class')}),
    c AS (SELECT room_class, count(*) AS n FROM h GROUP BY 1), t AS (SELECT trunc(quantile_cont(n, 0.7))::int AS target FROM c),
    k AS (SELECT row_id, hotel_name, room_class, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth, row_number() OVER (PARTITION BY room_class ORDER BY md5('43|' || row_id)) AS at1 FROM h),
    kept AS (SELECT k.row_id, k.hotel_name, k.room_class, h.price, h.area, h.people FROM k JOIN h USING (row_id), t WHERE nth <= target),
    d AS (SELECT room_class, n, unnest(range(1, greatest(target - n, 0)::bigint + 1)) AS draw FROM c, t),
    x AS (SELECT room_class, draw, ('0x' || substr(md5('43|' || room_class || '|' || draw), 1, 12))::bigint % n + 1 AS at1 FROM d),
    ranks AS (SELECT room_class, price, area, people, {', '.join(f'row_number() OVER (PARTITION BY room_class ORDER BY {v}, row_id) AS at_{v}' for v in ('price', 'area', 'people'))}, count(*) OVER (PARTITION BY room_class) AS size FROM h),
    scores AS (SELECT room_class, {', '.join(f"{_quantile_sql(f'((at_{v} - 0.5) / size::double)')} AS z_{v}" for v in ('price', 'area', 'people'))} FROM ranks),
    related AS (SELECT room_class, coalesce(corr(z_price, z_area), 0) AS pa, coalesce(corr(z_price, z_people), 0) AS pp, coalesce(corr(z_area, z_people), 0) AS ap FROM scores GROUP BY 1),
    factors AS (SELECT room_class, pa, pp, sqrt(greatest(1 - pa * pa, 0)) AS l11, coalesce((ap - pp * pa) / nullif(sqrt(greatest(1 - pa * pa, 0)), 0), 0) AS l21 FROM related),
    normals AS (SELECT room_class, n, draw, {', '.join(f"{_quantile_sql(f'u_{v}')} AS e_{v}" for v in ('price', 'area', 'people'))} FROM (SELECT room_class, n, draw, {', '.join(f"(('0x' || substr(md5('44|' || room_class || '|' || draw || '|{v}'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double AS u_{v}" for v in ('price', 'area', 'people'))} FROM d)),
    made AS (SELECT room_class, n, draw, e_price AS z_price, pa * e_price + l11 * e_area AS z_area, pp * e_price + l21 * e_area + sqrt(greatest(1 - pp * pp - l21 * l21, 0)) * e_people AS z_people FROM normals JOIN factors USING (room_class)),
    shares AS (SELECT room_class, n, draw, {', '.join(f"{_share_sql(f'z_{v}')} AS s_{v}" for v in ('price', 'area', 'people'))} FROM made),
    every AS (SELECT row_id, hotel_name, room_class, price, area, people, 'Real' AS row_origin FROM kept
     UNION ALL SELECT a.row_id || '-g' || x.draw, a.hotel_name, x.room_class, p.price, q.area, r.people, 'AI_Generated' FROM x JOIN k a ON x.room_class = a.room_class AND x.at1 = a.at1
      JOIN {_value_sql('price', 's_price')} p ON p.room_class = x.room_class AND p.draw = x.draw JOIN {_value_sql('area', 's_area')} q ON q.room_class = x.room_class AND q.draw = x.draw JOIN {_value_sql('people', 's_people')} r ON r.room_class = x.room_class AND r.draw = x.draw)
    SELECT row_id, hotel_name, room_class, price, area, people, row_origin FROM ({_inside('every', 'price', 1.5, 'room_class')})""")
def balanced_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.balanced_rooms(rooms(spark, sf_dir)).select("row_id", "hotel_name", "room_class", "price", "area", "people", "row_origin")


_NUMBERS = ["price", "people", "area", "price_per_m2", "m2_per_person", "num_facilities"]


@query("E8 E9 W7", f"""
    WITH {_FEATURES}, r AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _NUMBERS)} FROM feats), l AS (SELECT room_class, row_number() OVER (ORDER BY room_class) - 1 AS room_class_index FROM (SELECT DISTINCT room_class FROM feats)),
    c AS (SELECT room_class, count(*) AS n FROM feats GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth FROM feats),
    t AS (SELECT ceil(round(sum(n) * 0.3, 6))::bigint AS want, sum(n) AS total FROM c),
    e AS (SELECT room_class, n, floor(n * want / total)::bigint AS low, n * want / total - floor(n * want / total) AS part, want FROM c, t),
    f AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS rest FROM e),
    t2 AS (SELECT sum(rest) AS total, ceil(round(sum(rest) * 0.5, 6))::bigint AS want FROM f),
    e2 AS (SELECT f.room_class, f.rest, floor(f.rest * t2.want / t2.total)::bigint AS low, f.rest * t2.want / t2.total - floor(f.rest * t2.want / t2.total) AS part, t2.want FROM f, t2),
    q AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS test, rest - low - CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS validation FROM e2)
    SELECT row_id, {', '.join(f'round(coalesce(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), 0), 9) AS {c}' for c in _NUMBERS)}, has_luxury_keyword, {', '.join(_NAMES)}, room_class, room_class_index, CASE WHEN nth <= test THEN 'test' WHEN nth <= test + validation THEN 'validation' ELSE 'train' END AS split
    FROM k JOIN q USING (room_class) JOIN l USING (room_class), r""")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stages.scaled_features(rooms(spark, sf_dir))
    return table.select("row_id", *[F.round(c, 9).alias(c) for c in _NUMBERS], "has_luxury_keyword", *_NAMES, "room_class", "room_class_index", "split")
