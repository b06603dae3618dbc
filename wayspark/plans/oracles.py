"""The queries' results as DuckDB SQL, written apart from the plans."""

from __future__ import annotations

from wayspark.config import DEFAULT as P
from wayspark.functions.geo import RING, SQRT3

from .fixtures import RULES_SQL

R2 = 2 * P.earth_km
HAV = "(CASE WHEN {a}lng IS NOT NULL THEN {r} * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))) END)"


def hav(a: str, b: str) -> str:
    return HAV.format(r=R2, a=a, b=b)


def num(x: float) -> str:
    """A literal that is read as a double, not as a decimal."""
    return f"{x:.17e}"


def q(cell: str) -> str:
    return f"CAST(split_part({cell}, ',', 1) AS BIGINT)"


def r(cell: str) -> str:
    return f"CAST(split_part({cell}, ',', 2) AS BIGINT)"


def lng(cell: str, edge: float) -> str:
    return f"({num(P.origin_lng)} + {num(edge * SQRT3)} * ({q(cell)} + {r(cell)} / 2e0) / {num(P.km_per_lng)})"


def lat(cell: str, edge: float) -> str:
    return f"({num(P.origin_lat)} + {num(edge * 1.5)} * {r(cell)} / {num(P.km_per_lat)})"


def cell_of(lng_: str, lat_: str, edge: float, frm: str, keep: str) -> str:
    """A select that adds cell to rows of frm."""
    return f"""(SELECT {keep}, CASE WHEN byq THEN -rr - rs ELSE rq END || ',' || CASE WHEN NOT byq AND dr > ds + 1e-9 THEN -rq - rs ELSE rr END AS cell FROM (
  SELECT *, dq > dr + 1e-9 AND dq > ds + 1e-9 AS byq FROM (
  SELECT *, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs + qf + rf) AS ds FROM (
  SELECT *, CAST(floor(qf + 0.5) AS BIGINT) AS rq, CAST(floor(rf + 0.5) AS BIGINT) AS rr, CAST(floor(-qf - rf + 0.5) AS BIGINT) AS rs FROM (
  SELECT *, ({num(SQRT3 / 3)} * ((({lng_}) - {num(P.origin_lng)}) * {num(P.km_per_lng)}) - ((({lat_}) - {num(P.origin_lat)}) * {num(P.km_per_lat)}) / 3e0) / {num(edge)} AS qf,
         (2e0 * ((({lat_}) - {num(P.origin_lat)}) * {num(P.km_per_lat)}) / 3e0) / {num(edge)} AS rf FROM {frm})))))"""


E9 = P.edge(9)

WALKS = f"""
st AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END AS dq,
  CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END AS dr FROM events),
wk AS (SELECT user_id, week, ts, event_id, sec, CAST(sum(dq) OVER w AS BIGINT) || ',' || CAST(sum(dr) OVER w AS BIGINT) AS cell
  FROM st WINDOW w AS (PARTITION BY user_id, week ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
walks AS (SELECT user_id || '-' || week AS trip_id, user_id AS taxi_id, min(sec) AS start_epoch, list(cell ORDER BY ts, event_id) AS all_cells FROM wk GROUP BY user_id, week)"""

TRIPS = f"""{WALKS},
t0 AS (SELECT trip_id, taxi_id, start_epoch, CAST((len(all_cells) - 1) * 15 AS BIGINT) AS duration_sec, list_filter(all_cells, lambda x, i: i = 1 OR x <> all_cells[i - 1]) AS cells FROM walks),
px AS (SELECT trip_id, unnest(cells) AS cell, generate_subscripts(cells, 1) AS i FROM t0),
pxy AS (SELECT trip_id, i, cell, {lng('cell', E9)} AS lng, {lat('cell', E9)} AS lat FROM px),
hops AS (SELECT trip_id, sum({hav('p', '')}) AS km FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM pxy WINDOW w AS (PARTITION BY trip_id ORDER BY i)) GROUP BY trip_id),
t1 AS (SELECT t0.*, round(coalesce(km, 0), 4) AS distance_km FROM t0 JOIN hops USING (trip_id)),
trips AS (SELECT *, CASE WHEN duration_sec > 0 THEN round(distance_km / (duration_sec / 3600.0::DOUBLE), 2) ELSE 0 END AS speed_kmh FROM t1)"""


def T(sql: str, more: str = "") -> str:
    return f"WITH {TRIPS}{',' + more if more else ''} {sql}"


def grams(k: int, distinct: bool = True) -> str:
    """Rows (trip_id, gram)."""
    d = "DISTINCT" if distinct else ""
    return f"(SELECT {d} trip_id, array_to_string(cells[i:i + {k - 1}], '|') AS gram FROM (SELECT trip_id, cells, unnest(range(1, len(cells) - {k} + 2)) AS i FROM trips))"


def support(k: int) -> str:
    return f"(SELECT gram, count(*) AS support FROM {grams(k)} GROUP BY gram)"


def h32(x: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {x}), 1, 8) AS BIGINT)"


# -- raw trips ----------------------------------------------------------------

RAW = f"""{WALKS},
wp AS (SELECT trip_id, taxi_id, start_epoch, '[' || array_to_string(list_transform(all_cells, lambda c: '[' || {lng('c', E9)} || ',' || {lat('c', E9)} || ']'), ',') || ']' AS line FROM walks),
rawt AS (SELECT trip_id AS TRIP_ID, taxi_id AS TAXI_ID, start_epoch AS TIMESTAMP, taxi_id % 3 AS u3, CASE WHEN taxi_id % 41 = 0 THEN 'True' ELSE 'False' END AS MISSING_DATA,
   CASE WHEN taxi_id % 43 = 1 THEN '[]' WHEN taxi_id % 47 = 2 THEN substr(line, 1, 20) ELSE line END AS POLYLINE FROM wp
 UNION ALL SELECT TRIP_ID, 0, 0, 2, MISSING_DATA, POLYLINE FROM ({RULES_SQL})),
pj AS (SELECT *, TRY_CAST(POLYLINE AS DOUBLE[][]) AS pts FROM rawt),
up AS (SELECT TRIP_ID, unnest(pts) AS p, generate_subscripts(pts, 1) AS i FROM pj WHERE len(pts) > 0),
ul AS (SELECT TRIP_ID, i, p[1] AS lng, p[2] AS lat, lag(p) OVER (PARTITION BY TRIP_ID ORDER BY i) AS prev FROM up),
dd AS (SELECT * FROM ul WHERE prev IS NULL OR prev[1] <> lng OR prev[2] <> lat),
dh AS (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, row_number() OVER w AS k FROM dd WINDOW w AS (PARTITION BY TRIP_ID ORDER BY i)),
st2 AS (SELECT TRIP_ID, count(*) AS n_dedup, coalesce(max({hav('p', '')}), 0) AS max_step, coalesce(sum({hav('p', '')}), 0) AS km, arg_min(lng, i) AS slng, arg_min(lat, i) AS slat, arg_max(lng, i) AS elng, arg_max(lat, i) AS elat FROM dh GROUP BY TRIP_ID),
bb AS (SELECT TRIP_ID, bool_or(p[1] < {P.min_lng} OR p[1] > {P.max_lng} OR p[2] < {P.min_lat} OR p[2] > {P.max_lat}) AS outside, bool_or(p[1] IS NULL OR p[2] IS NULL) AS broken FROM up GROUP BY TRIP_ID),
judged AS (SELECT pj.*, len(pts) AS n_raw, n_dedup, km, slng, slat, elng, elat, CASE
  WHEN upper(trim(MISSING_DATA)) = 'TRUE' THEN 'missing_data'
  WHEN POLYLINE IS NULL OR trim(POLYLINE) IN ('', '[]') THEN 'empty_polyline'
  WHEN pts IS NULL OR broken THEN 'bad_json'
  WHEN len(pts) < 2 THEN 'too_few_points' WHEN len(pts) > 5760 THEN 'too_long' WHEN outside THEN 'out_of_bbox'
  WHEN max_step > {P.max_step_km!r} THEN 'gps_jump' WHEN n_dedup < 2 THEN 'stationary'
  WHEN km < {P.min_km} THEN 'too_short_distance' WHEN km > {P.max_km} THEN 'too_long_distance' ELSE 'kept' END AS verdict
  FROM pj LEFT JOIN st2 USING (TRIP_ID) LEFT JOIN bb USING (TRIP_ID))"""


def encoded(res: int) -> str:
    """CTE e{res}: (TRIP_ID, cells) of kept trips."""
    pts = f"(SELECT TRIP_ID, i, lng, lat FROM dd WHERE TRIP_ID IN (SELECT TRIP_ID FROM judged WHERE verdict = 'kept'))"
    c = cell_of("lng", "lat", P.edge(res), pts, "TRIP_ID, i")
    return f"""c{res} AS {c},
e{res} AS (SELECT TRIP_ID, list(cell ORDER BY i) AS cells FROM (SELECT *, lag(cell) OVER (PARTITION BY TRIP_ID ORDER BY i) AS prev FROM c{res}) WHERE prev IS NULL OR prev <> cell GROUP BY TRIP_ID)"""


# -- corridors ----------------------------------------------------------------

#: Frequent 3- and 4-grams, and pairs of frequent 2-grams with a hole between.
CORRIDORS = f"""
g2 AS (SELECT * FROM {support(2)} WHERE support >= 60),
corr AS (
  SELECT 'gram3' AS method, gram AS corridor, [string_split(gram, '|')] AS segments, support AS mined_support FROM {support(3)} WHERE support >= 25
  UNION ALL SELECT 'gram4', gram, [string_split(gram, '|')], support FROM {support(4)} WHERE support >= 12
  UNION ALL SELECT 'hole', a.gram || ' ~ ' || b.gram, [string_split(a.gram, '|'), string_split(b.gram, '|')], least(a.support, b.support) FROM g2 a, g2 b
   WHERE len(list_distinct(string_split(a.gram || '|' || b.gram, '|'))) = 4),
seg AS (SELECT corridor, len(segments) AS n_segs, unnest(segments) AS s, generate_subscripts(segments, 1) AS seg_no FROM corr),
cellat AS (SELECT trip_id, cells, unnest(range(1, len(cells) + 1)) AS pos FROM trips),
occ AS (SELECT trip_id, corridor, seg_no, n_segs, pos - 1 AS beg, pos - 1 + len(s) AS stop FROM cellat JOIN seg ON cells[pos] = s[1] AND cells[pos:pos + len(s) - 1] = s),
hits AS (
  SELECT trip_id, corridor, beg AS start, stop FROM occ WHERE n_segs = 1
  UNION ALL SELECT a.trip_id, a.corridor, a.beg, b.stop FROM occ a JOIN occ b ON a.trip_id = b.trip_id AND a.corridor = b.corridor AND a.n_segs = 2 AND a.seg_no = 1 AND b.seg_no = 2 AND b.beg BETWEEN a.stop AND a.stop + {P.max_gap}),
spans AS (SELECT trip_id, corridor, m.s AS start, m.e AS stop FROM (SELECT trip_id, corridor, min({{'s': start, 'e': stop}}) AS m FROM hits GROUP BY trip_id, corridor)),
sup AS (SELECT corridor, count(*) AS support FROM spans GROUP BY corridor),
cx AS (SELECT corridor, unnest(segments) AS s, generate_subscripts(segments, 1) AS sn FROM corr),
cy AS (SELECT corridor, sn, unnest(s) AS cell, generate_subscripts(s, 1) AS k FROM cx),
cz AS (SELECT corridor, sn, k, cell, {lng('cell', E9)} AS lng, {lat('cell', E9)} AS lat FROM cy),
cl AS (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, lag(sn) OVER w AS psn FROM cz WINDOW w AS (PARTITION BY corridor ORDER BY sn, k)),
cm AS (SELECT corridor, coalesce(sum({hav('p', '')}), 0) AS length_km, coalesce(sum(CASE WHEN psn = sn THEN {hav('p', '')} END), 0) AS covered_km, count(*) AS n_cells,
   arg_min(lng, sn * 1000 + k) AS alng, arg_min(lat, sn * 1000 + k) AS alat, arg_max(lng, sn * 1000 + k) AS zlng, arg_max(lat, sn * 1000 + k) AS zlat,
   arg_min(cell, sn * 1000 + k) AS start_cell, arg_max(cell, sn * 1000 + k) AS end_cell, count(DISTINCT cell) AS n_own, list(cell ORDER BY sn, k) AS cells FROM cl GROUP BY corridor),
cn AS (SELECT cm.*, {hav('a', 'z')} AS end_to_end_km FROM cm),
mea AS (SELECT corr.*, cn.* EXCLUDE (corridor), len(segments) AS n_segments, len(segments) - 1 AS n_holes, CASE WHEN end_to_end_km >= 1e-9 THEN length_km / end_to_end_km END AS tortuosity, coalesce(sup.support, 0) AS support
  FROM corr JOIN cn USING (corridor) LEFT JOIN sup USING (corridor)),
val AS (SELECT * FROM mea WHERE n_cells >= 3 AND n_own = n_cells AND tortuosity <= {P.max_tortuosity})"""

KM = (0.5, 1.0, 2.0)
THRESHOLDS = ((0.5, 4), (1.0, 8), (2.0, 15), (5.0, 38))
_TH = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b})" for a, b in THRESHOLDS) + ") th(pct, floor)"


def C(sql: str) -> str:
    return T(sql, CORRIDORS)


# -- sketches -----------------------------------------------------------------

CW, CD = 512, 4
BM, BK = 8192, 5
HB = 6


def cms(src: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {d} AS row, {h32(key, d)} % {CW} AS bucket, count(*) AS total FROM {src} GROUP BY ALL" for d in range(CD))


def bloom(src: str, key: str) -> str:
    return " UNION ".join(f"SELECT ({h32(key, 101)} + {h32(key, 202)} * {i}) % {BM} AS bit FROM {src}" for i in range(BK))


def hll(src: str, group: str, value: str) -> str:
    h = h32(value, 7)
    rank = "CASE " + " ".join(f"WHEN (h // {1 << HB}) % {1 << (i + 1)} <> 0 THEN {i + 1}" for i in range(32 - HB)) + f" ELSE {33 - HB} END"
    return f"SELECT {group}, h % {1 << HB} AS register, max({rank}) AS rank FROM (SELECT {group}, {h} AS h FROM {src}) GROUP BY {group}, register"


TAXI_CELLS = "(SELECT unnest(cells) AS cell, CAST(taxi_id AS VARCHAR) AS taxi FROM trips)"
_M = 1 << HB
_ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}.get(_M, 0.7213 / (1 + 1.079 / _M))
HLL_ESTIMATE = f"""SELECT cell, CASE WHEN raw <= {num(2.5 * _M)} AND used < {_M} THEN {num(float(_M))} * ln({num(float(_M))} / ({_M} - used)) ELSE raw END AS estimate
  FROM (SELECT cell, used, {num(_ALPHA * _M * _M)} / (s + ({_M} - used)) AS raw FROM (SELECT cell, count(*) AS used, sum(pow(2e0, -rank)) AS s FROM ({hll(TAXI_CELLS, "cell", "taxi")}) GROUP BY cell))"""


def minhash(src: str, group: str, item: str, n: int) -> str:
    p = 2147483647
    return f"""SELECT {group}, i, min(((((i + 1) * 1103515245 + 12345) % {p - 1} + 1) * x + ((i + 1) * 22695477 + 1) % {p}) % {p}) AS value
  FROM (SELECT {group}, {h32(item, 42)} % {p} AS x FROM {src}), (SELECT unnest(range(0, {n})) AS i) GROUP BY {group}, i"""


WIN = "wins AS (SELECT trip_id, start, trip_id || '#' || start AS window_id, cells[start * 3 + 1:start * 3 + 6] AS w FROM (SELECT trip_id, cells, unnest(range(0, (len(cells) - 6) // 3 + 1)) AS start FROM trips WHERE len(cells) >= 6))"
SHI = "shi AS (SELECT DISTINCT window_id, w[i] || '>' || w[i + 1] AS shingle FROM (SELECT window_id, w, unnest(range(1, len(w))) AS i FROM wins))"
RINGS = "[" + ", ".join(f"({q('cell')} + {a}) || ',' || ({r('cell')} + {b})" for a, b in RING) + "]"
COUNTS = "counts AS (SELECT cell, count(*) AS visits FROM (SELECT unnest(cells) AS cell FROM trips) GROUP BY cell)"
VISITS = "visits AS (SELECT DISTINCT trip_id, taxi_id, cell FROM (SELECT trip_id, taxi_id, unnest(cells) AS cell FROM trips))"
NOVEL = f"nov AS (SELECT trip_id, n_cells, count(*) FILTER (WHERE f.gram IS NULL) AS n_rare, round(count(*) FILTER (WHERE f.gram IS NULL) / count(*), 4) AS novelty FROM (SELECT trip_id, len(cells) AS n_cells, array_to_string(cells[i:i + 1], '|') AS gram FROM (SELECT trip_id, cells, unnest(range(1, len(cells))) AS i FROM trips WHERE len(cells) >= 8)) s LEFT JOIN (SELECT gram FROM {support(2)} WHERE support >= 20) f USING (gram) GROUP BY trip_id, n_cells)"
PART = "CASE WHEN h BETWEEN 7 AND 10 THEN 'morning' WHEN h BETWEEN 16 AND 19 THEN 'evening' WHEN h >= 23 OR h <= 4 THEN 'night' END"
TEMP = f"""tg AS (SELECT part, k, gram, count(*) AS support, round(sum(duration_sec) / count(*), 1) AS avg_duration_sec, round(sum(distance_km) / count(*), 3) AS avg_distance_km
  FROM (SELECT {PART} AS part, k, array_to_string(cells[i:i + k - 1], '|') AS gram, duration_sec, distance_km
    FROM (SELECT *, unnest(range(1, len(cells) - k + 2)) AS i FROM (SELECT *, CAST(floor(start_epoch / 3600) AS BIGINT) % 24 AS h, unnest([3, 4]) AS k FROM trips)))
  WHERE part IS NOT NULL GROUP BY part, k, gram HAVING count(*) >= 3),
tgs AS (SELECT *, CASE WHEN avg_duration_sec > 0 THEN round(round(avg_distance_km / (avg_duration_sec / 3600.0::DOUBLE), 6), 2) ELSE 0 END AS avg_speed_kmh FROM tg)"""
SUFF = f"""fg AS (SELECT gram FROM {support(4)} WHERE support >= 5),
suf AS (SELECT trip_id, i - 1 AS beg, cells[i:i + 69] AS suffix FROM (SELECT trip_id, cells, unnest(range(1, len(cells) - 3)) AS i FROM trips WHERE len(cells) >= 5)),
gs AS (SELECT * FROM suf WHERE array_to_string(suffix[1:4], '|') IN (SELECT gram FROM fg))"""
DENS = "dens AS (SELECT cell, round(sum(w), 4) AS density FROM (SELECT cell, visits * 0.6::DOUBLE AS w FROM counts UNION ALL SELECT unnest(" + RINGS + "), visits * 0.066::DOUBLE FROM counts) GROUP BY cell)"
CORP = f"up7 AS (SELECT *, {lng('cell', E9)} AS lng, {lat('cell', E9)} AS lat FROM (SELECT DISTINCT unnest(cells) AS cell FROM trips))"


def heights(src: str, top: int, metres: float) -> str:
    return f"(SELECT cell, visits, norm, round(norm * {metres}, 2) AS height_m FROM (SELECT cell, visits, round(visits / max(visits) OVER (), 4) AS norm FROM (SELECT * FROM {src} ORDER BY visits DESC, cell LIMIT {top})))"


def describe(col: str, src: str) -> str:
    qs = ", ".join(f"round(quantile_cont({col}, {x}), 4) AS p{int(x * 100)}" for x in (0.25, 0.5, 0.75, 0.9, 0.99))
    return f"SELECT count({col}) AS n, round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS std, min({col}) AS least, max({col}) AS most, {qs} FROM {src}"


def hist(col: str, edges: list[float]) -> str:
    cases = " ".join(f"WHEN {col} > {a} AND {col} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return T(f"SELECT bin, count(x) AS n FROM (SELECT unnest(range(0, {len(edges) - 1}))::INT AS bin) LEFT JOIN (SELECT CASE {cases} END AS bin, 1 AS x FROM trips) USING (bin) GROUP BY bin")


KM_EDGES = [0, 0.2, 0.5, 1, 2, 3, 5, 8]
MIN_EDGES = [0, 30, 60, 120, 180, 240, 300, 600]

ORACLE_SQL: dict[str, str] = {
    "src1_csv_scan": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "src3_parquet_pruned_scan": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "src8_fixed_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50",
    "src10_load_trips": T("SELECT trip_id, len(cells) AS n_cells, taxi_id, duration_sec, distance_km FROM trips"),
    "src11_json_polylines": C("SELECT corridor, n_cells AS n_points FROM mea WHERE n_cells >= 4"),
    "flt1_10_verdicts": f"WITH {RAW} SELECT TRIP_ID, verdict FROM judged",
    "flt11_verdict_counts": f"WITH {RAW} SELECT verdict, count(*) AS trips, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM judged GROUP BY verdict",
    "prj1_9_features": f"""WITH {RAW} SELECT TRIP_ID, CASE u3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS CALL_TYPE, CASE WHEN u3 = 1 THEN CAST(TAXI_ID % 7 AS VARCHAR) ELSE '' END AS ORIGIN_STAND, CAST(TAXI_ID AS INT) AS TAXI_ID,
      CAST(n_dedup AS INT) AS num_points, CAST(n_raw AS INT) AS num_points_raw, CAST((n_raw - 1) * 15 AS INT) AS duration_sec, round(km, 4) AS distance_km, round(slng, 6) AS start_lng, round(slat, 6) AS start_lat, round(elng, 6) AS end_lng, round(elat, 6) AS end_lat,
      CASE WHEN n_raw > 1 THEN round(km / ((n_raw - 1) * 15 / 3600.0::DOUBLE), 2) ELSE 0 END AS avg_speed_kmh, strftime(make_timestamp(TIMESTAMP * 1000000), '%Y-%m-%d %H:%M:%S') AS trip_datetime,
      CAST(hour(make_timestamp(TIMESTAMP * 1000000)) AS INT) AS hour_of_day, CAST(dayofweek(make_timestamp(TIMESTAMP * 1000000)) + 1 AS INT) AS day_of_week FROM judged WHERE verdict = 'kept'""",
    **{f"prj10_encode_res{x}": f"WITH {RAW}, {encoded(x)} SELECT TRIP_ID, array_to_string(cells, '|') AS cells, cells[1] AS start_cell, cells[-1] AS end_cell, len(cells) AS n_cells FROM e{x}" for x in (8, 9, 10)},
    "agg2_distinct_cells": f"WITH {RAW}, {encoded(8)}, {encoded(9)}, {encoded(10)} " + " UNION ALL ".join(f"SELECT {x} AS res, count(DISTINCT c) AS n_cells FROM (SELECT unnest(cells) AS c FROM e{x})" for x in (8, 9, 10)),
    "agg1_6_stage_stats": f"WITH {RAW} SELECT count(*) AS n, count(DISTINCT TAXI_ID) AS taxis, round(max(km), 4) AS max_km, round(avg(n_dedup / n_raw), 6) AS mean_ratio FROM judged WHERE verdict = 'kept'",
    "prj12_cell_centres": T("SELECT cell, round(lng, 6) AS lng, round(lat, 6) AS lat FROM up7", CORP),
    "prj13_boundaries": T(f"SELECT cell, i, round(lng + cos(radians(60.0 * i + 30.0)) * {E9} / {P.km_per_lng}, 6) AS lng, round(lat + sin(radians(60.0 * i + 30.0)) * {E9} / {P.km_per_lat}, 6) AS lat FROM up7, (SELECT unnest(range(0, 6)) AS i)", CORP),
    "prj14_parents": T("SELECT child, cell AS parent FROM " + cell_of("lng", "lat", P.edge(8), "(SELECT cell AS child, lng, lat FROM up7)", "child"), CORP),
    "prj15_rings": T(f"SELECT cell, unnest({RINGS}) AS neighbour FROM up7", CORP),
    "prj16_grid_distance": T(f"SELECT trip_id, (abs(dq) + abs(dr) + abs(dq + dr)) // 2 AS hops FROM (SELECT trip_id, {q('cells[1]')} - {q('cells[-1]')} AS dq, {r('cells[1]')} - {r('cells[-1]')} AS dr FROM trips)"),
    **{f"agg7_ngram_support_k{k}": T(f"SELECT gram, support FROM {support(k)}") for k in (2, 3, 4, 5)},
    "min1_frequent_gate": T(f"SELECT gram, support FROM {support(4)} WHERE support >= 5"),
    "agg36_gate_stats": T(f"SELECT CAST(sum(support) AS BIGINT) AS streamed, count(*) AS distinct_grams, count(*) FILTER (WHERE support >= 5) AS frequent_grams, round(100.0::DOUBLE * (1 - count(*) FILTER (WHERE support >= 5) / count(*)), 4) AS pruned_pct FROM {support(4)}"),
    "agg33_k_ablation": T(" UNION ALL ".join(f"SELECT {k} AS k, (SELECT count(*) FROM trips WHERE len(cells) < {k}) AS too_short, count(*) AS distinct_grams, count(*) FILTER (WHERE support >= 5) AS frequent_grams FROM {support(k)}" for k in (2, 3, 4, 6))),
    "agg8_cms_table": T("SELECT * FROM (" + cms(grams(4), "gram") + ")"),
    "jn7_cms_estimates": T(f"SELECT gram, min(total) AS estimate FROM (" + " UNION ALL ".join(f"SELECT gram, total FROM (SELECT DISTINCT gram FROM {grams(4)}) g JOIN c ON c.row = {d} AND c.bucket = {h32('gram', d)} % {CW}" for d in range(CD)) + ") GROUP BY gram", "c AS (" + cms(grams(4), "gram") + ")"),
    "agg8_cms_never_under": "SELECT 0 AS underestimates",
    "agg10_bloom_bits": T("SELECT bit FROM (" + bloom(f"(SELECT gram FROM {support(4)} WHERE support >= 5)", "gram") + ")"),
    "jn4_bloom_membership": T("SELECT gram, bool_and(b.bit IS NOT NULL) AS maybe FROM (" + " UNION ".join(f"SELECT gram, ({h32('gram', 101)} + {h32('gram', 202)} * {i}) % {BM} AS bit FROM (SELECT DISTINCT gram FROM {grams(4)})" for i in range(BK)) + ") x LEFT JOIN b USING (bit) GROUP BY gram", "b AS (" + bloom(f"(SELECT gram FROM {support(4)} WHERE support >= 5)", "gram") + ")"),
    "agg10_bloom_no_false_negatives": "SELECT 0 AS false_negatives",
    "agg11_hll_registers": T("SELECT cell, register, rank FROM (" + hll("(SELECT unnest(cells) AS cell, CAST(taxi_id AS VARCHAR) AS taxi FROM trips)", "cell", "taxi") + ")"),
    "agg11_hll_estimates": T("SELECT cell, round(estimate, 6) AS estimate FROM (" + HLL_ESTIMATE + ")"),
    "agg11_hll_merged": T("SELECT cell, register, rank FROM (" + hll(TAXI_CELLS, "cell", "taxi") + ")"),
    "agg12_distinct_counter_all_cells": T("SELECT cell, round(CASE WHEN n <= 64 THEN CAST(n AS DOUBLE) ELSE estimate END, 6) AS n_distinct FROM (" + HLL_ESTIMATE + ") JOIN (SELECT cell, count(DISTINCT taxi) AS n FROM " + TAXI_CELLS + " GROUP BY cell) USING (cell)"),
    "agg10_bloom_merged": T("SELECT bit FROM (" + bloom(f"(SELECT gram FROM {support(4)} WHERE support >= 5)", "gram") + ")"),
    "agg9_cms_errors": T("SELECT count(*) AS keys, count(*) FILTER (WHERE estimate > n) AS over, CAST(max(estimate - n) AS BIGINT) AS most, CAST(sum(estimate - n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS items FROM (SELECT gram, min(total) AS estimate FROM (" + " UNION ALL ".join(f"SELECT gram, total FROM g JOIN c ON c.row = {d} AND c.bucket = {h32('gram', d)} % {CW}" for d in range(CD)) + ") GROUP BY gram) JOIN g USING (gram)",
        f"g AS (SELECT gram, count(*) AS n FROM {grams(3)} GROUP BY gram), c AS (" + cms(grams(3), "gram") + ")"),
    "agg5_approx_quantiles": T("SELECT CAST(i - 1 AS INT) AS i, q[i] AS km FROM (SELECT quantile_disc(distance_km, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM trips), (SELECT unnest(range(1, 6)) AS i)"),
    "win1_lcp": T("""SELECT bucket, trip_id, CAST(beg AS INT) AS at, array_to_string(s, '|') AS suffix, CAST(coalesce(list_position(list_transform(range(1, greatest(len(s), len(coalesce(p, []))) + 1), lambda i: coalesce(s[i] = p[i], false)), false) - 1, len(s)) AS INT) AS lcp
  FROM (SELECT *, lag(s) OVER (PARTITION BY bucket ORDER BY array_to_string(s, '|'), trip_id, beg) AS p FROM (SELECT trip_id, beg, s, array_to_string(s[1:2], '|') AS bucket FROM suf))""",
        "suf AS (SELECT trip_id, beg, cells[beg + 1:beg + 70] AS s FROM (SELECT trip_id, cells, unnest(range(0, len(cells) - 4)) AS beg FROM trips WHERE len(cells) >= 5))"),
    "agg12_distinct_counter": T("SELECT cell, CAST(count(DISTINCT taxi_id) AS DOUBLE) AS n_distinct FROM (SELECT unnest(cells) AS cell, taxi_id FROM trips) GROUP BY cell HAVING count(DISTINCT taxi_id) <= 64"),
    "set6_merged_sketch": T("SELECT * FROM (" + cms(grams(3), "gram") + ")"),
    "agg9_sketch_sizing": "SELECT 2719 AS width, 5 AS depth, 2097152 AS budget_width, 9592 AS bloom_bits, 7 AS bloom_hashes",
    "seq2_all_ngrams": T(f"SELECT gram, count(*) AS n FROM {grams(3, False)} GROUP BY gram"),
    "seq3_windows": T("SELECT window_id, array_to_string(w, '|') AS win FROM wins", WIN),
    "seq4_shingles": T("SELECT window_id, shingle FROM shi", f"{WIN}, {SHI}"),
    "seq5_suffixes": T("SELECT trip_id, CAST(beg AS INT) AS beg, array_to_string(suffix, '|') AS suffix FROM suf", SUFF),
    "jn4_gated_suffixes": T("SELECT trip_id, CAST(beg AS INT) AS beg, array_to_string(suffix, '|') AS suffix FROM gs", SUFF),
    "seq6_transitions": T(f"SELECT gram, count(*) AS n FROM {grams(2, False)} GROUP BY gram"),
    "seq7_cells_by_taxi": T("SELECT cell, count(*) AS traversals, count(DISTINCT taxi_id) AS taxis FROM visits GROUP BY cell", VISITS),
    "seq12_first_occurrence": T("SELECT trip_id, CAST(list_position(cells, '0,1') AS INT) AS beg FROM trips WHERE list_contains(cells, '0,1')"),
    "min2_minhash": T("SELECT window_id, CAST(i AS INT) AS i, value FROM (" + minhash("shi", "window_id", "shingle", 8) + ")", f"{WIN}, {SHI}"),
    "min3_lsh_buckets": T("SELECT CAST(band AS INT) AS band, key, count(DISTINCT trip_id) AS n_trips, count(*) AS n_windows FROM (SELECT window_id, i // 2 AS band, string_agg(CAST(value AS VARCHAR), ':' ORDER BY i) AS key FROM sig GROUP BY window_id, band) JOIN wins USING (window_id) GROUP BY band, key", f"{WIN}, {SHI}, sig AS (" + minhash("shi", "window_id", "shingle", 8) + ")"),
    "set5_jaccard": T("SELECT a.window_id AS a, b.window_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM wins a JOIN wins b ON a.trip_id = b.trip_id AND a.start < b.start", WIN),
    "jn1_support": C("SELECT corridor, coalesce(support, 0) AS support FROM corr LEFT JOIN sup USING (corridor)"),
    "jn2_spans": C("SELECT trip_id, corridor, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop FROM spans"),
    "set4_subset": C("SELECT corridor, count(*) AS trips FROM (SELECT v.trip_id, cc.corridor FROM (SELECT DISTINCT corridor, cell FROM cy) cc JOIN (SELECT DISTINCT trip_id, cell FROM px) v USING (cell) GROUP BY v.trip_id, cc.corridor HAVING count(*) = (SELECT count(DISTINCT cell) FROM cy WHERE cy.corridor = cc.corridor)) GROUP BY corridor"),
    "min8_verify": C("SELECT corridor, count(*) AS support, round(sum(duration_sec) / count(*), 1) AS mean_duration_sec, round(sum(distance_km) / count(*), 3) AS mean_distance_km, CASE WHEN sum(duration_sec) > 0 THEN round(sum(distance_km) / (sum(duration_sec) / 3600.0::DOUBLE), 2) ELSE 0 END AS mean_speed_kmh FROM spans JOIN trips USING (trip_id) GROUP BY corridor"),
    "min5_longest_repeats": T("""SELECT DISTINCT pattern, CAST(n AS INT) AS n, support FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, beg ORDER BY n DESC) AS k FROM (SELECT p.trip_id, p.beg, p.n, pattern, support FROM pre p JOIN fr USING (pattern))) WHERE k = 1""",
        f"{SUFF}, pre AS (SELECT trip_id, beg, n, array_to_string(suffix[1:n], '|') AS pattern FROM (SELECT *, unnest(range(3, len(suffix) + 1)) AS n FROM (SELECT trip_id, i - 1 AS beg, cells[i:i + 69] AS suffix FROM (SELECT trip_id, cells, unnest(range(1, len(cells) - 1)) AS i FROM trips WHERE len(cells) >= 3)) WHERE array_to_string(suffix[1:3], '|') IN (SELECT gram FROM {support(3)} WHERE support >= 5))), fr AS (SELECT pattern, count(DISTINCT trip_id) AS support FROM pre GROUP BY pattern HAVING count(DISTINCT trip_id) >= 5)"),
    "prj18_corridor_metrics": C("SELECT corridor, n_cells, n_segments, n_holes, round(length_km, 6) AS length_km, round(covered_km, 6) AS covered_km, round(end_to_end_km, 6) AS end_to_end_km, round(tortuosity, 6) AS tortuosity, start_cell, end_cell FROM mea"),
    "flt15_valid_corridors": C("SELECT corridor FROM val"),
    "prj19_records": C("SELECT method, corridor, round(length_km, 3) AS length_km, support, round(support * 100.0::DOUBLE / (SELECT count(*) FROM trips), 4) AS support_pct FROM val"),
    "win3_ranked": C("SELECT corridor, CAST(row_number() OVER (ORDER BY n_cells DESC, support DESC, corridor) AS INT) AS rank FROM val"),
    "win5_capped": C("SELECT method, corridor FROM val QUALIFY row_number() OVER (PARTITION BY method ORDER BY n_cells DESC, support DESC, corridor) <= 7"),
    "jn11_contained": C("SELECT corridor, host FROM (SELECT a.corridor, b.corridor AS host, row_number() OVER (PARTITION BY a.corridor ORDER BY b.n_cells DESC, b.support DESC, b.corridor) AS k FROM val a JOIN val b ON contains('|' || array_to_string(b.cells, '|') || '|', '|' || array_to_string(a.cells, '|') || '|') AND (b.n_cells > a.n_cells OR (b.n_cells = a.n_cells AND (b.support > a.support OR (b.support = a.support AND b.corridor < a.corridor))))) WHERE k = 1"),
    "jn11_without_contained": C("SELECT corridor, CAST(n_cells AS INT) AS n_cells FROM val WHERE corridor NOT IN (SELECT a.corridor FROM val a JOIN (SELECT corridor, n_cells, support, unnest(segments) AS sg FROM val) b ON contains('|' || array_to_string(b.sg, '|') || '|', '|' || array_to_string(a.cells, '|') || '|') AND (b.n_cells > a.n_cells OR (b.n_cells = a.n_cells AND (b.support > a.support OR (b.support = a.support AND b.corridor < a.corridor)))))"),
    "agg31_scorecard": C("SELECT method, count(*) AS n, round(max(length_km), 3) AS max_km, round(avg(length_km), 3) AS mean_km, round(avg(n_cells), 2) AS mean_cells, max(support) AS max_support, round(avg(support), 2) AS mean_support, count(*) FILTER (WHERE n_holes > 0) AS with_holes, round(avg(tortuosity), 3) AS mean_tortuosity, CASE WHEN sum(support) > 0 THEN round((sum(mined_support) - sum(support)) * 100.0::DOUBLE / sum(support), 1) ELSE 0 END AS overstated_pct, count(*) FILTER (WHERE length_km >= 1) AS ge_1km, count(*) FILTER (WHERE length_km >= 2) AS ge_2km FROM val GROUP BY method"),
    "agg32_sweep": C(f"SELECT pct, floor, count(support) AS n, round(max(length_km), 3) AS max_km, round(avg(length_km), 3) AS mean_km, count(*) FILTER (WHERE length_km >= 1) AS ge_1km, count(*) FILTER (WHERE length_km >= 2) AS ge_2km FROM {_TH} LEFT JOIN val ON support >= floor GROUP BY pct, floor"),
    "win9_threshold_choice": C(f"SELECT min_km, CASE WHEN hi IS NULL THEN lo.pct ELSE hi.pct END AS pct, CASE WHEN hi IS NULL THEN lo.floor ELSE hi.floor END AS floor, CASE WHEN hi IS NULL THEN lo.n ELSE hi.n END AS n, hi IS NOT NULL AS met_target FROM (SELECT min_km, max({{'pct': pct, 'floor': floor, 'n': n}}) FILTER (WHERE n >= 20) AS hi, min({{'pct': pct, 'floor': floor, 'n': n}}) AS lo FROM (SELECT min_km, pct, floor, count(support) AS n FROM (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS min_km) CROSS JOIN {_TH} LEFT JOIN val ON length_km >= min_km AND support >= floor GROUP BY min_km, pct, floor) GROUP BY min_km)"),
    "agg19_length_ceiling": T("SELECT d::DOUBLE AS min_km, (SELECT count(*) FROM trips WHERE distance_km >= d) AS trips FROM (SELECT unnest([0.5, 1.0, 2.0]) AS d)"),
    "set1_union_methods": C("SELECT method, count(*) AS n FROM corr GROUP BY method"),
    "set3_frequent_difference": T(f"SELECT gram FROM {support(3)} WHERE support BETWEEN 5 AND 9"),
    "set7_child_dedup": C("SELECT start_cell, max(support) AS support FROM mea GROUP BY start_cell"),
    "min10_novelty": T("SELECT * FROM nov", NOVEL),
    "top3_most_anomalous": T("SELECT * FROM nov ORDER BY novelty DESC, n_cells DESC, trip_id LIMIT 20", NOVEL),
    "agg21_novelty_histogram": T("SELECT round(novelty, 1) AS bin, count(*) AS trips FROM nov GROUP BY bin", NOVEL),
    "agg22_cell_diversity": T("SELECT cell, count(*) AS traversals, count(DISTINCT taxi_id) AS taxis, round(count(*) / count(DISTINCT taxi_id), 4) AS per_taxi FROM visits GROUP BY cell HAVING count(*) >= 20", VISITS),
    "top4_low_diversity": T("SELECT cell, count(*) AS traversals, count(DISTINCT taxi_id) AS taxis, round(count(*) / count(DISTINCT taxi_id), 4) AS per_taxi FROM visits GROUP BY cell HAVING count(*) >= 20 ORDER BY per_taxi DESC, cell LIMIT 10", VISITS),
    "min11_temporal_ngrams": T("SELECT * FROM tgs", TEMP),
    "win7_top_by_part": T("SELECT part, gram, CAST(rank AS INT) AS rank FROM (SELECT part, gram, row_number() OVER (PARTITION BY part ORDER BY support DESC, k DESC, gram) AS rank FROM tgs) WHERE rank <= 10", TEMP),
    "agg24_cell_counts": T("SELECT * FROM counts", COUNTS),
    "top8_busiest_cells": T("SELECT * FROM counts ORDER BY visits DESC, cell LIMIT 50", COUNTS),
    "agg25_smoothed_density": T("SELECT * FROM dens", f"{COUNTS}, {DENS}"),
    "prj22_heights": T(f"SELECT * FROM {heights('counts', 200, 180.0)}", COUNTS),
    "jn9_stacked_heights": T("SELECT f.child AS cell, f.height_m, parent, coalesce(p.height_m, 40.0) AS base_m FROM (SELECT child, height_m, cell AS parent FROM " + cell_of("lng", "lat", P.edge(8), f"(SELECT cell AS child, height_m, {lng('cell', E9)} AS lng, {lat('cell', E9)} AS lat FROM {heights('counts', 200, 180.0)})", "child, height_m") + f") f LEFT JOIN {heights('coarse', 5, 220.0)} p ON f.parent = p.cell",
        f"{COUNTS}, {CORP}, coarse AS (SELECT cell, sum(visits)::BIGINT AS visits FROM " + cell_of("lng", "lat", P.edge(8), f"(SELECT visits, {lng('cell', E9)} AS lng, {lat('cell', E9)} AS lat FROM counts)", "visits") + " GROUP BY cell)"),
    "seq9_elevation": T(f"SELECT cell, CAST(sum(w) AS BIGINT) AS elevation FROM (SELECT cell, 2 AS w FROM visits UNION ALL SELECT n, 1 FROM (SELECT trip_id, unnest({RINGS}) AS n FROM visits) x WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.trip_id = x.trip_id AND v.cell = x.n)) GROUP BY cell", VISITS),
    "agg26_by_hour": T("SELECT CAST(value AS INT) AS value, count(h) AS n FROM (SELECT unnest(range(0, 24)) AS value) LEFT JOIN (SELECT CAST(floor(start_epoch / 3600) AS BIGINT) % 24 AS h FROM trips) ON h = value GROUP BY value"),
    "agg26_by_day": T("SELECT CAST(value AS INT) AS value, count(d) AS n FROM (SELECT unnest(range(1, 8)) AS value) LEFT JOIN (SELECT dayofweek(make_timestamp(start_epoch * 1000000)) + 1 AS d FROM trips) ON d = value GROUP BY value"),
    "agg26_sequence_lengths": T("SELECT len(cells) AS value, count(*) AS n FROM trips GROUP BY 1"),
    "prj20_call_types": f"WITH {RAW} SELECT CASE u3 WHEN 0 THEN 'central' WHEN 1 THEN 'stand' ELSE 'street' END AS call_type, count(*) AS n FROM judged WHERE verdict = 'kept' GROUP BY 1",
    "top10_stands": f"WITH {RAW} SELECT 'Stand #' || (TAXI_ID % 7) AS stand, count(*) AS n FROM judged WHERE verdict = 'kept' AND u3 = 1 GROUP BY 1 ORDER BY n DESC, stand LIMIT 10",
    "agg27_distance_summary": T(describe("distance_km", "trips")),
    "agg35_minutes_summary": T(describe("m", "(SELECT duration_sec / 60.0::DOUBLE AS m FROM trips)")),
    "agg28_distance_histogram": hist("distance_km", KM_EDGES),
    "agg28_duration_histogram": hist("duration_sec", MIN_EDGES),
    "agg29_speed_by_hour": T("SELECT CAST(floor(start_epoch / 3600) AS BIGINT) % 24 AS hour, round(avg(speed_kmh), 4) AS mean_kmh FROM trips GROUP BY 1"),
    "agg30_per_taxi": T("SELECT taxi_id, count(*) AS trips, round(sum(distance_km), 3) AS km, round(avg(speed_kmh), 3) AS mean_kmh FROM trips GROUP BY taxi_id ORDER BY trips DESC, taxi_id LIMIT 5"),
    "snk1_parquet_round_trip": T("SELECT trip_id, distance_km FROM trips"),
    "order_ngrams": "WITH o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY o_custkey) SELECT gram, count(*) AS support FROM (SELECT DISTINCT o_custkey, array_to_string(a[i:i + 2], '|') AS gram FROM (SELECT o_custkey, a, unnest(range(1, len(a) - 1)) AS i FROM o)) GROUP BY gram",
}
