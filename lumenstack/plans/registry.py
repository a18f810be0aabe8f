"""Every query of the library with its SQL.  Numbers are rounded on both sides, since sums run in other orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, cluster, layout, linalg, maps, masks, objects, register, spatial, tracking, wavelet, window
from ..streaming import stateful
from .views import CUBE, DAILY, ROI_ROWS, ROIS, STACK, TRACES, cube_events, rois, stack_emb, trace_cells, trace_daily, traces_emb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PX = ["row", "col"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column = "value", name: str = "value") -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c, c) if c in names else F.col(c) for c in df.columns])


R = "round({}, 6) + 0.0"
V = "round(value, 6) + 0.0 AS value"


# Layout, slices and projections.


@query(f"WITH {CUBE} SELECT row, col, {R.format('avg(value)')} AS value FROM cube GROUP BY row, col")
def mean_frame(s, d):
    return rounded(aggregate.mean_frame(cube_events(s, d)), "value")


@query(f"WITH {CUBE} SELECT row, col, {R.format('max(value)')} AS value FROM cube GROUP BY row, col")
def max_project(s, d):
    return rounded(aggregate.max_project(cube_events(s, d)), "value")


@query(f"WITH {CUBE} SELECT {R.format('stddev_pop(value)')} AS std FROM cube")
def global_std(s, d):
    return rounded(aggregate.global_std(cube_events(s, d)), "std")


@query(f"WITH {CUBE} SELECT {R.format('min(value)')} AS low, {R.format('max(value)')} AS high FROM cube")
def data_range(s, d):
    return rounded(aggregate.data_range(cube_events(s, d)), "low", "high")


@query(f"WITH {CUBE} SELECT p, {R.format('v')} AS value FROM (SELECT unnest([1.0, 25.0, 50.0, 99.0]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.01, 0.25, 0.5, 0.99])) AS v FROM cube)")
def data_percentile(s, d):
    return rounded(aggregate.percentiles(cube_events(s, d), [1, 25, 50, 99]), "value")


@query(f"WITH {CUBE} SELECT row, col, {R.format('median(value)')} AS value FROM cube GROUP BY row, col")
def time_project_median(s, d):
    return rounded(aggregate.time_project(cube_events(s, d), "median"), "value")


@query(f"WITH {CUBE} SELECT row, col, {R.format('stddev_pop(value)')} AS value FROM cube GROUP BY row, col")
def time_project_std(s, d):
    return rounded(aggregate.time_project(cube_events(s, d), "std"), "value")


@query(f"WITH {CUBE} SELECT count(DISTINCT t) AS n_frames, (max(row) + 1)::BIGINT AS h, (max(col) + 1)::BIGINT AS w FROM cube")
def sequence_shape(s, d):
    return aggregate.shape(cube_events(s, d))


@query(f"WITH {CUBE} SELECT t, row, col, {V} FROM cube WHERE t BETWEEN 2 AND 19 AND (t - 2) % 3 = 0 AND row BETWEEN 1 AND 5 AND col BETWEEN 2 AND 6")
def crop_slice(s, d):
    return rounded(layout.crop(cube_events(s, d), (2, 20), (1, 6), (2, 7), step=3), "value")


@query(f"WITH {CUBE} SELECT t, row, col, {V} FROM cube WHERE t < 10 AND t % 2 = 0")
def take_frames(s, d):
    return rounded(layout.take(cube_events(s, d), 10, 2), "value")


@query(f"WITH {CUBE} SELECT t, (7 - row)::INTEGER AS row, (7 - col)::INTEGER AS col, {V} FROM cube")
def flip_frames(s, d):
    return rounded(layout.flip(cube_events(s, d), 8, 8), "value")


@query(f"WITH {CUBE} SELECT t, row, col, {V} FROM cube UNION ALL SELECT t + 30, row, col, {V} FROM cube WHERE t < 5")
def concat_sequences(s, d):
    c = cube_events(s, d)
    return rounded(layout.concat([c, layout.take(c, 5)]), "value")


@query(f"WITH {STACK} SELECT t, row, col, {V} FROM st")
def frames_round_trip(s, d):
    return rounded(layout.frames_to_cells(layout.to_frames(stack_emb(s, d))), "value")


@query(f"WITH {TRACES} SELECT row, col, t, {V} FROM tr")
def traces_round_trip(s, d):
    return rounded(layout.traces_to_cells(layout.to_traces(trace_cells(s, d))), "value")


@query(f"WITH {CUBE} SELECT t, row, col, {V}, t * 0.25::DOUBLE AS ts FROM cube")
def frame_times(s, d):
    return rounded(layout.times(cube_events(s, d), 0.25, "s"), "value")


# Masks and regions of interest.

MASK = "mask AS (SELECT row, col FROM (SELECT row, col, avg(value) AS m FROM cube GROUP BY row, col) WHERE m > 45.0)"


def _mask(c: DataFrame) -> DataFrame:
    return aggregate.mean_frame(c).filter("value > 45.0")


@query(f"WITH {CUBE}, {MASK} SELECT t, {R.format('avg(value)')} AS value FROM cube SEMI JOIN mask USING (row, col) GROUP BY t")
def mask_reduce(s, d):
    c = cube_events(s, d)
    return rounded(aggregate.mask_reduce(c, _mask(c)), "value")


@query(f"WITH {CUBE} SELECT t, {R.format('avg(value * (row / 7.0::DOUBLE))')} AS value FROM cube WHERE row > 0 GROUP BY t")
def softmask_reduce(s, d):
    c = cube_events(s, d)
    return rounded(aggregate.softmask_reduce(c, c.select("row", "col", (F.col("row") / 7.0).alias("weight")).distinct()), "value")


ROI_TRACE = f"WITH {CUBE}, {ROIS}, rt AS (SELECT tag, t, avg(value) AS value FROM cube JOIN rois ON (col - cx) * (col - cx) + (row - cy) * (row - cy) <= r * r GROUP BY tag, t)"


@query(f"{ROI_TRACE} SELECT tag, t, {V} FROM rt")
def roi_trace(s, d):
    return rounded(aggregate.roi_trace(cube_events(s, d), rois(s)), "value")


@query(f"""{ROI_TRACE}, b AS (SELECT *, avg(CASE WHEN t < 10 THEN value END) OVER (PARTITION BY tag) AS b FROM rt)
SELECT tag, t, round(CASE WHEN abs(b) >= 1e-6 THEN value / b - 1 ELSE 0 END, 6) + 0.0 AS value FROM b""")
def dfof_roi(s, d):
    return rounded(window.dfof(aggregate.roi_trace(cube_events(s, d), rois(s)), ["tag"], 10), "value")


@query(f"{ROI_TRACE} SELECT x.tag AS a, y.tag AS b, {R.format('CASE WHEN stddev_pop(x.value) * stddev_pop(y.value) > 0 THEN corr(x.value, y.value) END')} AS r FROM rt x JOIN rt y ON x.t = y.t AND x.tag > y.tag GROUP BY 1, 2")
def roi_xcorr_matrix(s, d):
    return rounded(maps.roi_matrix(aggregate.roi_trace(cube_events(s, d), rois(s))), "r")


IMG = "img AS (SELECT row, col, avg(value) AS value FROM cube GROUP BY row, col)"


def _img(s, d):
    return aggregate.mean_frame(cube_events(s, d))


def _masked(x: DataFrame) -> DataFrame:
    return x.select("row", "col", F.col("mask").cast("int").alias("mask"))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, (value > 45.0)::INTEGER AS mask FROM img")
def mask_threshold(s, d):
    return _masked(masks.threshold(_img(s, d), 45.0))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, (value > (SELECT max(value) - min(value) FROM img) * 30 / 100)::INTEGER AS mask FROM img")
def mask_percent_threshold(s, d):
    return _masked(masks.percent_threshold(_img(s, d), 30))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, (value > 3 * (SELECT stddev_pop(value) FROM img))::INTEGER AS mask FROM img")
def mask_num_std(s, d):
    return _masked(masks.num_std(_img(s, d), 3))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, (value > (SELECT median(value) + 0.5 * stddev_pop(value) FROM img))::INTEGER AS mask FROM img")
def mask_median_sd(s, d):
    return _masked(masks.median_sd(_img(s, d), 0.5))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, (NOT value < (SELECT quantile_cont(value, 0.2) FROM img))::INTEGER AS mask FROM img")
def mask_low_percentile_inverted(s, d):
    return _masked(masks.invert(masks.low_percentile(_img(s, d), 20)))


@query(f"WITH {CUBE}, {IMG} SELECT row, col, round(least(value, p) / p, 6) + 0.0 AS value FROM img, (SELECT quantile_cont(value, 0.84375) AS p FROM img)")
def clip_rescale(s, d):
    return rounded(masks.clip_rescale(_img(s, d), 10), "value")


@query(f"WITH {CUBE}, {IMG} SELECT row, col, round((value - a) / (b - a), 6) + 0.0 AS value FROM img, (SELECT min(value) AS a, max(value) AS b FROM img)")
def rescale(s, d):
    return rounded(masks.rescale(_img(s, d)), "value")


@query(f"""WITH {CUBE},
q AS (SELECT row, col, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS q2 FROM cube GROUP BY row, col)
SELECT row, col, {R.format('avg(value) FILTER (value > q3) / (stddev_pop(value) FILTER (value <= q2) + 1)')} AS value FROM cube JOIN q USING (row, col) GROUP BY row, col""")
def simple_snr(s, d):
    return rounded(aggregate.simple_snr(cube_events(s, d)), "value")


@query(f"""WITH RECURSIVE {CUBE}, t(i, th, done) AS (
  SELECT 0, (SELECT median(value) FROM cube), false
  UNION ALL SELECT i + 1, greatest(th, n), n <= th FROM (SELECT i, th, (SELECT (avg(value) FILTER (value <= th) + avg(value) FILTER (value > th)) / 2 FROM cube) AS n FROM t WHERE NOT done AND i < 64))
SELECT {R.format('max(th)')} AS threshold FROM t""")
def auto_threshold(s, d):
    return s.range(1).select(F.round(F.lit(aggregate.auto_threshold(cube_events(s, d))), 6).alias("threshold"))


# Along time.


@query(f"""WITH {TRACES}, b AS (SELECT *, avg(CASE WHEN t < 8 THEN value END) OVER w AS m, stddev_pop(CASE WHEN t < 8 THEN value END) OVER w AS s FROM tr WINDOW w AS (PARTITION BY row, col))
SELECT t, row, col, round(CASE WHEN s > 1e-6 THEN (value - m) / s ELSE 0 END, 6) + 0.0 AS value FROM b""")
def dfosd(s, d):
    return rounded(window.dfosd(trace_cells(s, d), PX, 8), "value")


@query(f"""WITH {DAILY}, m AS (SELECT flag, t, avg(value) OVER w AS value, count(*) OVER w AS n FROM daily WINDOW w AS (PARTITION BY flag ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT flag, t, round(value, 4) + 0.0 AS value FROM m WHERE n = 7""")
def ma2d(s, d):
    return window.moving_average(trace_daily(s, d), ["flag"], 7).select("flag", "t", (F.round("value", 4) + 0.0).alias("value"))


@query(f"WITH {TRACES} SELECT * FROM (SELECT t, row, col, {R.format('value - lag(value) OVER (PARTITION BY row, col ORDER BY t)')} AS value FROM tr) WHERE value IS NOT NULL")
def first_diff(s, d):
    return rounded(window.first_difference(trace_cells(s, d), PX), "value")


@query(f"WITH {TRACES} SELECT row, col, (t // 10)::BIGINT AS chunk, {R.format('avg(value)')} AS value FROM tr GROUP BY 1, 2, 3 HAVING count(*) = 10")
def by_chunks(s, d):
    return rounded(window.chunks(trace_cells(s, d), PX, 10), "value")


@query(f"""WITH {TRACES}, f AS (SELECT row, col, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM tr GROUP BY row, col)
SELECT t, row, col, round(value - a - b * t, 6) + 0.0 AS value FROM tr JOIN f USING (row, col)""")
def linear_detrend(s, d):
    return rounded(window.detrend(trace_cells(s, d), PX, 1), "value")


@query(f"""WITH {TRACES}, x AS (SELECT *, t - avg(t) OVER (PARTITION BY row, col) AS x FROM tr),
s AS (SELECT row, col, count(*)::DOUBLE AS n, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(value) AS y0, sum(x * value) AS y1, sum(x * x * value) AS y2 FROM x GROUP BY row, col),
f AS (SELECT *, n * (s2 * s4 - s3 * s3) - s2 * s2 * s2 AS det FROM s)
SELECT t, row, col, round(value - (y0 * (s2 * s4 - s3 * s3) + s2 * (y1 * s3 - s2 * y2)) / det - x * (n * (y1 * s4 - s3 * y2) - s2 * (s2 * y1 - s3 * y0)) / det - x * x * (n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / det, 6) + 0.0 AS value
FROM x JOIN f USING (row, col)""")
def poly_detrend(s, d):
    return rounded(window.detrend(trace_cells(s, d), PX, 2), "value")


@query(f"WITH {TRACES} SELECT t, row, col, {V} FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM tr WINDOW w AS (PARTITION BY row, col ORDER BY t)) WHERE value > a AND value > b")
def local_maxima(s, d):
    return rounded(window.local_maxima(trace_cells(s, d), PX), "value")


BASE = f"""{CUBE}, b AS (SELECT x.t, x.row, x.col, any_value(x.value) AS value, sum(exp(-(x.t - y.t) * (x.t - y.t) / 8.0::DOUBLE) * y.value) / sum(exp(-(x.t - y.t) * (x.t - y.t) / 8.0::DOUBLE)) AS b
  FROM cube x JOIN cube y ON x.row = y.row AND x.col = y.col AND abs(x.t - y.t) <= 8 GROUP BY x.t, x.row, x.col)"""


@query(f"WITH {BASE} SELECT t, row, col, round(CASE WHEN abs(b) >= 1e-6 THEN value / b - 1 ELSE 0 END, 6) + 0.0 AS value FROM b")
def mavg_dfof(s, d):
    return rounded(window.mavg_dfof(cube_events(s, d), PX, 2.0), "value")


@query(f"WITH {BASE}, e AS (SELECT *, stddev_pop(value - b) OVER (PARTITION BY row, col) AS sd FROM b) SELECT t, row, col, round(CASE WHEN sd >= 1e-6 THEN (value - b) / sd ELSE 0 END, 6) + 0.0 AS value FROM e")
def mavg_dfosd(s, d):
    return rounded(window.mavg_dfosd(cube_events(s, d), PX, 2.0), "value")


@query(f"WITH {CUBE}, {IMG} SELECT row, col, row_number() OVER (PARTITION BY row ORDER BY round(value, 9) DESC, col) AS rank FROM img")
def rank_pixels(s, d):
    return window.rank_by(_img(s, d), ["row"], F.round("value", 9), "col").select("row", "col", "rank")


# Neighbourhoods and regions.

NEAR = "n AS (SELECT x.t, x.row, x.col, any_value(x.value) AS value, count(*) AS n, avg(y.value) AS m, stddev_pop(y.value) AS s, median(y.value) AS q FROM cube x JOIN cube y ON x.t = y.t AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1 GROUP BY x.t, x.row, x.col)"


@query(f"WITH {CUBE}, {NEAR} SELECT t, row, col, round(CASE WHEN n = 9 AND abs(value - m) > 1.3 * s THEN q ELSE value END, 6) + 0.0 AS value FROM n")
def adaptive_median3(s, d):
    return rounded(spatial.adaptive_median3(cube_events(s, d), 1.3), "value")


@query(f"WITH {CUBE}, {NEAR} SELECT t, row, col, round(q, 6) + 0.0 AS value FROM n")
def median3(s, d):
    return rounded(spatial.median3(cube_events(s, d)), "value")


@query(f"""WITH {CUBE} SELECT x.t, x.row, x.col, {R.format('sum(k * y.value) / sum(k)')} AS value
FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS i FROM cube) x, (SELECT unnest([-2, -1, 0, 1, 2]) AS j) o, LATERAL (SELECT exp(-(i * i + j * j) / 2.0::DOUBLE) AS k), cube y WHERE y.t = x.t AND y.row = x.row + i AND y.col = x.col + j GROUP BY 1, 2, 3""")
def gauss_blur(s, d):
    return rounded(spatial.gauss_blur(cube_events(s, d), 1.0, 2), "value")


@query(f"WITH {CUBE} SELECT x.t, x.row, x.col, (any_value(x.value) > avg(y.value) - 1.5)::INTEGER AS mask FROM cube x JOIN cube y ON x.t = y.t AND abs(x.row - y.row) <= 2 AND abs(x.col - y.col) <= 2 GROUP BY 1, 2, 3")
def adaptive_threshold(s, d):
    return spatial.adaptive_threshold(cube_events(s, d), 2, 1.5).withColumn("mask", F.col("mask").cast("int"))


BIN = "bin AS (SELECT t, row, col FROM cube WHERE value > 65.0)"


def _bin(s, d):
    return cube_events(s, d).filter("value > 65.0").select("t", "row", "col")


OFF = "off AS (SELECT unnest([0, 0, 1, 0, -1]) AS i, unnest([0, 1, 0, -1, 0]) AS j)"


@query(f"WITH {CUBE}, {BIN} SELECT c.t, c.row, c.col FROM cube c JOIN bin b ON c.t = b.t AND abs(c.row - b.row) <= 1 AND abs(c.col - b.col) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def majority(s, d):
    return spatial.majority(_bin(s, d), 4).filter("row between 0 and 7 and col between 0 and 7")


@query(f"WITH {CUBE}, {BIN} SELECT c.t, c.row, c.col FROM bin c JOIN bin b ON c.t = b.t AND (c.row - b.row) * (c.row - b.row) + (c.col - b.col) * (c.col - b.col) <= 4 GROUP BY 1, 2, 3 HAVING count(*) > 5")
def density_filter(s, d):
    return spatial.density(_bin(s, d), 2, 5)


@query(f"WITH {CUBE}, {BIN}, {OFF} SELECT DISTINCT t, (row + i)::INTEGER AS row, (col + j)::INTEGER AS col FROM bin, off WHERE row + i BETWEEN 0 AND 7 AND col + j BETWEEN 0 AND 7")
def dilate(s, d):
    return spatial.dilate(_bin(s, d), 8, 8)


@query(f"WITH {CUBE}, {BIN}, {OFF} SELECT t, (row + i)::INTEGER AS row, (col + j)::INTEGER AS col FROM bin, off GROUP BY 1, 2, 3 HAVING count(*) = 5")
def erode(s, d):
    return spatial.erode(_bin(s, d))


@query(f"""WITH {CUBE}, {BIN}, {OFF},
d1 AS (SELECT DISTINCT t, row + i AS row, col + j AS col FROM bin, off WHERE row + i BETWEEN 0 AND 7 AND col + j BETWEEN 0 AND 7),
e1 AS (SELECT t, row + i AS row, col + j AS col FROM d1, off GROUP BY 1, 2, 3 HAVING count(*) = 5),
e2 AS (SELECT t, row + i AS row, col + j AS col FROM e1, off GROUP BY 1, 2, 3 HAVING count(*) = 5)
SELECT DISTINCT t, (row + i)::INTEGER AS row, (col + j)::INTEGER AS col FROM e2, off WHERE row + i BETWEEN 0 AND 7 AND col + j BETWEEN 0 AND 7""")
def opening_of_closing(s, d):
    return spatial.opening_of_closing(_bin(s, d), 8, 8)


REG = f"""WITH RECURSIVE {CUBE}, {BIN}, step(t, row, col, region) AS (
  SELECT t, row, col, (row * 8 + col)::BIGINT FROM bin
  UNION SELECT b.t, b.row, b.col, s.region FROM step s JOIN bin b ON b.t = s.t AND abs(b.row - s.row) + abs(b.col - s.col) = 1 WHERE b.row * 8 + b.col > s.region),
reg AS (SELECT t, row, col, min(region) AS region FROM step GROUP BY 1, 2, 3)"""
# Any region's least pixel reaches all of it over pixels with greater numbers than its own, so the least found is the name.


@query(f"{REG} SELECT t, row, col, region FROM reg")
def connected_regions(s, d):
    return spatial.regions(_bin(s, d), 8, 8)


@query(f"{REG} SELECT t, region, count(*) AS size, {R.format('avg(row)')} AS row_center, {R.format('avg(col)')} AS col_center, (max(row) - min(row))::BIGINT AS row_extent, (max(col) - min(col))::BIGINT AS col_extent FROM reg GROUP BY 1, 2 HAVING count(*) > 2")
def region_stats(s, d):
    return rounded(spatial.region_stats(spatial.filter_size(spatial.regions(_bin(s, d), 8, 8), 2)), "row_center", "col_center")


@query(f"{REG} SELECT t, region, {R.format('sqrt(max((x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col)))')} AS linsize FROM reg x JOIN reg y USING (t, region) GROUP BY 1, 2")
def region_linsize(s, d):
    return rounded(spatial.region_linsize(spatial.regions(_bin(s, d), 8, 8)), "linsize")


@query(f"""{REG} SELECT t, x.region AS a, y.region AS b, {R.format('min(sqrt((x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col)))')} AS distance
FROM reg x JOIN reg y USING (t) WHERE x.region < y.region GROUP BY 1, 2, 3 HAVING min((x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col)) <= 9""")
def region_distance(s, d):
    return rounded(spatial.region_distances(spatial.regions(_bin(s, d), 8, 8), 3), "distance")


@query(f"WITH {CUBE} SELECT t, i, {V} FROM cube JOIN (SELECT unnest(range(8)) AS i, unnest([{', '.join(str(r) for _, r, _ in spatial.line_samples(0, 1, 7, 6))}]) AS row, unnest([{', '.join(str(c) for _, _, c in spatial.line_samples(0, 1, 7, 6))}]) AS col) USING (row, col)")
def line_reslice(s, d):
    return rounded(spatial.line_reslice(cube_events(s, d), (0, 1, 7, 6)), "value")


@query(f"""WITH {CUBE}, m AS (SELECT t, covar_pop(col, col) AS cc, covar_pop(row, row) AS rr, covar_pop(row, col) AS rc, covar_pop(col, value) AS cv, covar_pop(row, value) AS rv, avg(col) AS mc, avg(row) AS mr, avg(value) AS mv FROM cube GROUP BY t),
p AS (SELECT *, (cv * rr - rv * rc) / (cc * rr - rc * rc) AS a, (rv * cc - cv * rc) / (cc * rr - rc * rc) AS b FROM m)
SELECT t, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(mv - a * mc - b * mr, 6) + 0.0 AS c FROM p""")
def plane_fit(s, d):
    return rounded(spatial.plane_fit(cube_events(s, d)), "a", "b", "c")


# Wavelets.


def _starlet_sql(level: int, source: str = TRACES, n: int = 64) -> str:
    """CTEs c0 ... c(level) of a trace's approximations, by an index table."""
    out = [source, f"c0 AS (SELECT row, col, t, value FROM {'tr'})"]
    for j in range(level):
        h = 2**j
        out.append(f"""k{j} AS (SELECT t, w, CASE WHEN k < 0 THEN -k WHEN k >= {n} THEN {n} - 2 - k % {n} ELSE k END AS k FROM (SELECT t, d * {h} + t AS k, w FROM range({n}) r(t), (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]::DOUBLE[]) / 16 AS w)))""")
        out.append(f"c{j + 1} AS (SELECT row, col, k{j}.t, sum(w * value) AS value FROM k{j} JOIN c{j} ON c{j}.t = k{j}.k GROUP BY 1, 2, 3)")
    return "WITH " + ", ".join(out)


@query(_starlet_sql(2) + f""" SELECT row, col, 0::BIGINT AS level, t, {R.format('c0.value - c1.value')} AS value FROM c0 JOIN c1 USING (row, col, t)
UNION ALL SELECT row, col, 1, t, {R.format('c1.value - c2.value')} FROM c1 JOIN c2 USING (row, col, t) UNION ALL SELECT row, col, 2, t, {R.format('value')} FROM c2""")
def starlet1d(s, d):
    return rounded(wavelet.coefficients(wavelet.decompose1d(traces_emb(s, d), 2, 64), 2, PX), "value")


def _cells(x: DataFrame) -> DataFrame:
    return rounded(layout.traces_to_cells(x), "value").select("row", "col", "t", "value")


@query(_starlet_sql(3) + f" SELECT row, col, t, {V} FROM c3")
def starlet_smooth(s, d):
    return _cells(wavelet.smooth1d(traces_emb(s, d), 3))


@query(_starlet_sql(3) + f" SELECT row, col, t, {R.format('c0.value - c3.value')} AS value FROM c0 JOIN c3 USING (row, col, t)")
def starlet_detrend(s, d):
    return _cells(wavelet.detrend1d(traces_emb(s, d), 3))


MAD_SQL = "w AS (SELECT row, col, t, c0.value - c1.value AS w FROM c0 JOIN c1 USING (row, col, t)), m AS (SELECT row, col, median(w) AS m FROM w GROUP BY 1, 2), sg AS (SELECT row, col, median(abs(w - m)) / (0.6745::DOUBLE * 0.7235::DOUBLE) AS sigma FROM w JOIN m USING (row, col) GROUP BY 1, 2)"


@query(_starlet_sql(1) + f", {MAD_SQL} SELECT row, col, {R.format('sigma')} AS sigma FROM sg")
def sigma_mad(s, d):
    return wavelet.sigma_mad(traces_emb(s, d)).select("row", "col", r6("sigma", "sigma"))


@query(_starlet_sql(2) + f""", {MAD_SQL}
SELECT row, col, t, round(c2.value + CASE WHEN abs(c0.value - c1.value) > 1.5 * 0.7235::DOUBLE * sigma THEN c0.value - c1.value ELSE 0 END + CASE WHEN abs(c1.value - c2.value) > 1.5 * 0.2854::DOUBLE * sigma THEN c1.value - c2.value ELSE 0 END, 6) + 0.0 AS value
FROM c0 JOIN c1 USING (row, col, t) JOIN c2 USING (row, col, t) JOIN sg USING (row, col)""")
def starlet_denoise(s, d):
    return _cells(wavelet.denoise1d(traces_emb(s, d), 2, 1.5))


@query(_starlet_sql(2) + f""" SELECT row, col, t, (2 * (abs(c0.value - c1.value) > 0.1 * 0.7235::DOUBLE)::INTEGER + 4 * (abs(c1.value - c2.value) > 0.1 * 0.2854::DOUBLE)::INTEGER)::BIGINT AS value
FROM c0 JOIN c1 USING (row, col, t) JOIN c2 USING (row, col, t)""")
def support_repr(s, d):
    c = wavelet.coefficients(wavelet.decompose1d(traces_emb(s, d), 2, 64), 2, PX).filter("level < 2")
    return wavelet.represent_support(wavelet.support(c, 0.1, 1.0), ["row", "col", "t"])


@query(f"WITH {TRACES} SELECT row, col, t, {V} FROM tr")
def starlet_reconstruct(s, d):
    return rounded(wavelet.reconstruct(wavelet.coefficients(wavelet.decompose1d(traces_emb(s, d), 4, 64), 4, PX), ["row", "col", "t"]), "value")


@query(f"""WITH {STACK}, k AS (SELECT t AS i, CASE WHEN k < 0 THEN -k WHEN k >= 8 THEN 6 - k % 8 ELSE k END AS k, w FROM (SELECT t, t + d AS k, w FROM range(8) r(t), (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]::DOUBLE[]) / 16 AS w))),
a AS (SELECT t, k.i AS row, col, sum(w * value) AS value FROM st JOIN k ON st.row = k.k GROUP BY 1, 2, 3), b AS (SELECT t, row, k.i AS col, sum(w * value) AS value FROM a JOIN k ON a.col = k.k GROUP BY 1, 2, 3)
SELECT t, 0::BIGINT AS level, st.row, st.col, {R.format('st.value - b.value')} AS value FROM st JOIN b USING (t, row, col) UNION ALL SELECT t, 1, row::INTEGER, col::INTEGER, {R.format('value')} FROM b""")
def starlet2d(s, d):
    return rounded(wavelet.decompose2d(layout.to_frames(stack_emb(s, d)), 1), "value")


def _median_sql(level: int, source: str, out: str, s: int) -> str:
    """A CTE of the medians of (2s + 1)-squares of 8 x 8 frames, mirrored without the edge (where s < 8)."""
    k = f"SELECT i, CASE WHEN k < 0 THEN -k WHEN k >= 8 THEN 14 - k ELSE k END AS k FROM (SELECT i, i + d AS k FROM range(8) a(i), range({-s}, {s + 1}) b(d))"
    return f"{out} AS MATERIALIZED (SELECT t, r.i AS row, c.i AS col, median(value) AS value FROM {source} x JOIN ({k}) r ON x.row = r.k JOIN ({k}) c ON x.col = c.k GROUP BY 1, 2, 3)"


@query(f"""WITH {STACK}, {_median_sql(0, 'st', 'm1', 2)}, {_median_sql(1, 'm1', 'm2', 4)}
SELECT t, 0::BIGINT AS level, row, col, {R.format('st.value - m1.value')} AS value FROM st JOIN m1 USING (t, row, col) UNION ALL
SELECT t, 1, row::INTEGER, col::INTEGER, {R.format('m1.value - m2.value')} FROM m1 JOIN m2 USING (t, row, col) UNION ALL SELECT t, 2, row::INTEGER, col::INTEGER, {R.format('value')} FROM m2""")
def median_pyramid2d(s, d):
    return rounded(wavelet.decompose2d(layout.to_frames(stack_emb(s, d)), 2, "median"), "value")


# Functional maps.

SIG = "sig AS (SELECT t, avg(value) AS s FROM tr GROUP BY t)"


def _signal(c: DataFrame) -> DataFrame:
    return c.groupBy("t").agg(F.avg("value").alias("s"))


@query(f"WITH {TRACES}, {SIG} SELECT row, col, {R.format('corr(value, s)')} AS value FROM tr JOIN sig USING (t) GROUP BY row, col")
def xcorr_pearson(s, d):
    c = trace_cells(s, d)
    return rounded(maps.xcorrmap(c, _signal(c)), "value")


@query(f"WITH {TRACES}, {SIG} SELECT row, col, {R.format('sum(value * s)')} AS value FROM tr JOIN sig USING (t) GROUP BY row, col")
def xcorr_dot(s, d):
    c = trace_cells(s, d)
    return rounded(maps.xcorrmap(c, _signal(c), "dot"), "value")


@query(f"""WITH {TRACES}, sig AS (SELECT t, t % 7 AS s FROM range(64) r(t)), r AS (SELECT row, col, rank() OVER (PARTITION BY row, col ORDER BY value) + (count(*) OVER (PARTITION BY row, col, value) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY row, col ORDER BY s) + (count(*) OVER (PARTITION BY row, col, s) - 1) / 2.0::DOUBLE AS b FROM tr JOIN sig USING (t)) SELECT row, col, {R.format('corr(a, b)')} AS value FROM r GROUP BY row, col""")
def xcorr_spearman(s, d):
    return rounded(maps.xcorrmap(trace_cells(s, d), s.range(64).select(F.col("id").alias("t"), F.pmod("id", F.lit(7)).alias("s")), "spearman"), "value")


@query(f"WITH {TRACES}, sig AS (SELECT t, 0.5 * (1 + tanh(t - 20) * tanh(40 - t)) AS s FROM range(64) r(t)) SELECT row, col, {R.format('corr(value, s)')} AS value FROM tr JOIN sig USING (t) GROUP BY row, col")
def actcorr_map(s, d):
    return rounded(maps.actcorrmap(trace_cells(s, d), 64, 20, 40), "value")


@query(f"""WITH {TRACES}, b AS (SELECT *, avg(CASE WHEN t < 10 THEN value END) OVER w AS m, stddev_pop(CASE WHEN t < 10 THEN value END) OVER w AS s FROM tr WINDOW w AS (PARTITION BY row, col))
SELECT row, col, {R.format('avg(CASE WHEN s > 1e-6 THEN (value - m) / s ELSE 0 END)')} AS value FROM b WHERE t > 20 AND t < 40 GROUP BY row, col""")
def meanact_map(s, d):
    return rounded(maps.meanactmap(trace_cells(s, d), 20, 40, 10), "value")


PAIRS = "FROM {0} x JOIN {0} y ON x.t = y.t AND abs(x.row - y.row) + abs(x.col - y.col) = 1 GROUP BY x.row, x.col, y.row, y.col"


@query(f"WITH {CUBE}, c AS (SELECT x.row, x.col, sum(x.value * y.value) AS c {PAIRS.format('cube')}) SELECT row, col, {R.format('avg(c)')} AS value FROM c GROUP BY row, col")
def local_corr(s, d):
    return rounded(maps.local_corr_map(cube_events(s, d)), "value")


@query(f"WITH {CUBE}, z AS (SELECT t, row, col, value - avg(value) OVER (PARTITION BY row, col) AS value FROM cube), c AS (SELECT x.row, x.col, avg((x.value * y.value > 0)::INTEGER) AS c {PAIRS.format('z')}) SELECT row, col, {R.format('avg(c)')} AS value FROM c GROUP BY row, col")
def local_coherence(s, d):
    return rounded(maps.local_coherence(cube_events(s, d)), "value")


@query(f"""WITH {TRACES}, {SIG}, c AS (SELECT row, col, lag, sum(value * s) AS c FROM tr JOIN (SELECT unnest(range(-5, 6)) AS lag, t, s FROM sig) g ON tr.t = g.t + lag GROUP BY 1, 2, 3)
SELECT row, col, arg_max(lag, (c, -lag))::BIGINT AS lag FROM c GROUP BY row, col""")
def xcorr_lag(s, d):
    c = trace_cells(s, d)
    return maps.corr_lag(c, _signal(c), 5)


@query(f"""WITH {TRACES}, z AS (SELECT row, col, t, value - avg(value) OVER (PARTITION BY row, col) AS v FROM tr), p AS (SELECT row, col, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, sum(v * sin(2 * pi() * k * t / 64)) AS im FROM z, (SELECT unnest(range(4, 10)) AS k) GROUP BY 1, 2, 3)
SELECT row, col, {R.format('avg(re * re + im * im)')} AS value FROM p GROUP BY row, col""")
def dft_band_power(s, d):
    return rounded(maps.band_power(trace_cells(s, d), 64, 4 / 64, 10 / 64), "value")


def _cwt_sql(freqs: list[float], start: int = 0, stop: int = 64) -> str:
    """CTEs up to en (row, col, f, t, e): Morlet energy by the discrete Fourier transform of traces of 64 samples."""
    psi = "pow(pi(), -0.25) * sqrt(2 * pi() * (6 / (2 * pi() * f))) * exp(-0.5 * pow(6 / (2 * pi() * f) * (2 * pi() * k / 64) - 6, 2))"
    return f"""WITH {TRACES}, z AS (SELECT row, col, t, value - avg(value) OVER (PARTITION BY row, col) AS v FROM tr),
sp AS MATERIALIZED (SELECT row, col, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im FROM z, (SELECT unnest(range(1, 32)) AS k) GROUP BY 1, 2, 3),
ps AS MATERIALIZED (SELECT f, k, t, {psi} / 64 * cos(2 * pi() * k * t / 64) AS c, {psi} / 64 * sin(2 * pi() * k * t / 64) AS s FROM (SELECT unnest({freqs}::DOUBLE[]) AS f), (SELECT unnest(range(1, 32)) AS k), (SELECT unnest(range({start}, {stop})) AS t)),
en AS (SELECT row, col, f, t, pow(sum(re * c - im * s), 2) + pow(sum(re * s + im * c), 2) AS e FROM sp JOIN ps USING (k) GROUP BY 1, 2, 3, 4)"""


@query(f"{_cwt_sql([0.05, 0.1, 0.2], 10, 50)} SELECT row, col, {R.format('avg(e)')} AS value FROM en GROUP BY 1, 2")
def cwt_energy_map(s, d):
    return rounded(maps.cwt_map(traces_emb(s, d), [0.05, 0.1, 0.2], 10, 50), "value")


@query(f"""{_cwt_sql([0.05, 0.1, 0.15, 0.2, 0.3], 10, 50)}, m AS (SELECT row, col, f, avg(e) AS e FROM en GROUP BY 1, 2, 3), l AS (SELECT row, col, regr_slope(e, f) AS b, regr_intercept(e, f) AS a FROM m GROUP BY 1, 2)
SELECT row, col, CASE WHEN max(e - a - b * f) >= 1e-7 THEN arg_max(f, e - a - b * f) END AS value FROM m JOIN l USING (row, col) GROUP BY 1, 2""")
def cwt_freq_map(s, d):
    return maps.cwt_freqmap(traces_emb(s, d), [0.05, 0.1, 0.15, 0.2, 0.3], 10, 50)


@query(f"{_cwt_sql([0.1, 0.2])} SELECT f AS freq, t, {R.format('avg(e)')} AS value FROM en GROUP BY 1, 2")
def cwt_mean_surface(s, d):
    return rounded(maps.avg_energy(traces_emb(s, d), [0.1, 0.2]), "value")


# Clusters and decompositions.


def _points(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _seeds(p: DataFrame, n: int) -> DataFrame:
    return p.filter(F.col("id") < n).select(F.col("id").alias("label"), F.col("x").alias("c"))


P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"WITH {P} SELECT a.id AS a, b.id AS b, {R.format(DIST)} AS distance FROM p a, p b WHERE b.id < 10 AND a.id <> b.id")
def pairwise_dist(s, d):
    p = _points(s, d)
    return rounded(cluster.pairwise(p, p.filter("id < 10")), "distance")


@query(f"WITH {P}, q AS (SELECT a.id, b.id AS label, {DIST} AS distance FROM p a, p b WHERE b.id < 10) SELECT id, label, {R.format('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS n FROM q) WHERE n = 1")
def bmu_assign(s, d):
    p = _points(s, d)
    return rounded(cluster.assign(p, _seeds(p, 10)).select("id", "label", "distance"), "distance")


@query(f"""WITH {P}, q AS (SELECT a.id, a.x, b.id AS label, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS n FROM p a, p b WHERE b.id < 10)
SELECT label, i, {R.format('avg(v)')} AS value FROM (SELECT label, unnest(range(len(x))) AS i, unnest(x) AS v FROM q WHERE n = 1) GROUP BY 1, 2""")
def kmeans_step(s, d):
    p = _points(s, d)
    x = cluster.kmeans_step(p, _seeds(p, 10)).select("label", F.posexplode("c").alias("i", "value"))
    return rounded(x.withColumn("i", F.col("i").cast("long")), "value")


@query(f"WITH {P} SELECT a.id AS a, b.id AS b, {R.format(DIST)} AS distance FROM p a, p b WHERE a.id < b.id AND {DIST} <= 1.1")
def eps_neighbours(s, d):
    return rounded(cluster.near_pairs(_points(s, d), 1.1), "distance")


@query(f"""WITH RECURSIVE {P}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE a.id <> b.id AND {DIST} <= 1.1), core AS (SELECT id FROM p LEFT JOIN e ON e.a = p.id GROUP BY id HAVING count(e.b) + 1 >= 4),
ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)), walk(node, root) AS (SELECT id, id FROM core UNION SELECT ce.b, walk.root FROM walk JOIN ce ON ce.a = walk.node WHERE walk.root < ce.b),
lab AS (SELECT node AS id, min(root) AS label FROM walk GROUP BY node), edge AS (SELECT e.a AS id, min(label) AS label FROM e JOIN lab ON lab.id = e.b WHERE e.a NOT IN (FROM core) GROUP BY 1)
SELECT p.id, coalesce(lab.label, edge.label, -1)::BIGINT AS label FROM p LEFT JOIN lab USING (id) LEFT JOIN edge USING (id)""")
def dbscan(s, d):
    return cluster.dbscan(_points(s, d), 1.1, 4)


def _lloyd_sql(rounds: int) -> str:
    """CTEs c0 ... c(rounds): centres (label, c) after each of Lloyd's rounds."""
    out = [f"WITH {P}", "c0 AS (SELECT id AS label, x AS c FROM p WHERE id < 10)"]
    for i in range(rounds):
        out.append(_assigned_sql(i))
        out.append(f"m{i} AS (SELECT label, list(v ORDER BY k) AS c FROM (SELECT label, k, avg(v) AS v FROM (SELECT label, unnest(range(len(x))) AS k, unnest(x) AS v FROM a{i}) GROUP BY 1, 2) GROUP BY 1)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT label, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (label))")
    return ", ".join([*out, _assigned_sql(rounds)])


def _assigned_sql(i: int) -> str:
    d = "sqrt(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    return f"a{i} AS MATERIALIZED (SELECT id, x, label, d FROM (SELECT p.id, p.x, b.label, {d} AS d, row_number() OVER (PARTITION BY p.id ORDER BY {d}, b.label) AS n FROM p, c{i} b) WHERE n = 1)"


@query(f"{_lloyd_sql(6)} SELECT label, count(*) AS mass, {R.format('avg(d)')} AS distortion FROM a6 GROUP BY 1")
def kmeans(s, d):
    p = _points(s, d)
    return rounded(cluster.cluster_stats(cluster.assign(p, cluster.kmeans(p, _seeds(p, 10), 6))), "distortion")


def _som_sql(epochs: int) -> str:
    """CTEs c0 ... c(epochs): centres of a 3 x 3 map after each epoch, from the sums of the points that each has won."""
    out = [f"WITH {P}", "c0 AS (SELECT id AS label, x AS c FROM p WHERE id < 9)"]
    for i in range(epochs):
        out.append(_assigned_sql(i))
        out.append(f"m{i} AS (SELECT label, k, sum(v) AS s, count(*) AS n FROM (SELECT label, unnest(range(len(x))) AS k, unnest(x) AS v FROM a{i}) GROUP BY 1, 2)")
        h = f"exp(-(pow(l // 3 - label // 3, 2) + pow(l % 3 - label % 3, 2)) / pow(2.0::DOUBLE * pow(0.9::DOUBLE, {i}), 2))"
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT l AS label, list(v ORDER BY k) AS c FROM (SELECT l, k, sum({h} * s) / sum({h} * n) AS v FROM m{i}, range(9) g(l) GROUP BY 1, 2) GROUP BY 1)")
    return ", ".join([*out, _assigned_sql(epochs)])


@query(f"{_som_sql(3)} SELECT label, count(*) AS mass, {R.format('avg(d)')} AS distortion FROM a3 GROUP BY 1")
def som(s, d):
    p = _points(s, d)
    m = cluster.som(p, (3, 3), _seeds(p, 9), 3)
    return rounded(cluster.cluster_stats(cluster.assign(p, m)), "distortion")


@query(f"""SELECT round(degrees(atan2(2 * covar_pop(l_discount * 100, l_quantity), var_pop(l_quantity) - var_pop(l_discount * 100)) / 2), 6) AS angle,
round((var_pop(l_quantity) + var_pop(l_discount * 100)) / 2 + sqrt(pow((var_pop(l_quantity) - var_pop(l_discount * 100)) / 2, 2) + pow(covar_pop(l_discount * 100, l_quantity), 2)), 6) AS major,
round((var_pop(l_quantity) + var_pop(l_discount * 100)) / 2 - sqrt(pow((var_pop(l_quantity) - var_pop(l_discount * 100)) / 2, 2) + pow(covar_pop(l_discount * 100, l_quantity), 2)), 6) AS minor FROM lineitem""")
def pca_points(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rounded(linalg.pca_points(x), "angle", "major", "minor")


@query()
def pca_projection(s, d):
    p = _points(s, d)
    mean, axes, _ = linalg.pca(p, 3)
    return linalg.project(p, mean, axes).select("id", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query()
def fastica(s, d):
    p = _points(s, d)
    mean, axes = linalg.fastica(p, 3, 20)
    return linalg.project(p, mean, axes).select("id", F.transform("p", lambda v: F.round(v, 4)).alias("p"))


# Registration, tracking and objects.


@query(f"""WITH {CUBE}, g AS (SELECT t, row // 4 AS tr, col // 4 AS tc, (lead(value) OVER a - lag(value) OVER a) / 2 AS iy, (lead(value) OVER b - lag(value) OVER b) / 2 AS ix, value - lead(value) OVER c AS it FROM cube
  WINDOW a AS (PARTITION BY t, col ORDER BY row), b AS (PARTITION BY t, row ORDER BY col), c AS (PARTITION BY row, col ORDER BY t)),
m AS (SELECT t, tr::BIGINT AS tr, tc::BIGINT AS tc, sum(iy * iy) AS yy, sum(iy * ix) AS xy, sum(ix * ix) AS xx, sum(iy * it) AS yt, sum(ix * it) AS xt FROM g WHERE iy IS NOT NULL AND ix IS NOT NULL AND it IS NOT NULL GROUP BY 1, 2, 3)
SELECT t, tr, tc, {R.format('(yt * xx - xt * xy) / (yy * xx - xy * xy)')} AS vy, {R.format('(xt * yy - yt * xy) / (yy * xx - xy * xy)')} AS vx FROM m WHERE yy * xx - xy * xy > 1e-9""")
def lk_flow(s, d):
    return rounded(register.lk_flow(cube_events(s, d), 4), "vy", "vx")


@query()
def register_shifts(s, d):
    c = cube_events(s, d)
    return register.register_shifts(layout.to_frames(c), register.template(c, 0, 30))


@query(f"""WITH RECURSIVE {CUBE}, f AS MATERIALIZED (SELECT t, list(value ORDER BY row, col) AS m FROM cube GROUP BY t),
k(t, p, e) AS (SELECT -1, (SELECT list(v ORDER BY row, col) FROM (SELECT row, col, avg(value) AS v FROM cube GROUP BY 1, 2)), [0.05::DOUBLE for i in range(64)]
  UNION ALL SELECT t, list_transform(z, lambda x: x[1]), list_transform(z, lambda x: x[2]) FROM (
    SELECT k.t + 1 AS t, list_transform(list_zip(p, e, m), lambda x: [x[1] + (1 + 0.5 * (x[2] / (x[2] + 0.05) - 1)) * (x[3] - x[1]), -x[2] * 0.5 * (x[2] / (x[2] + 0.05) - 1) + pow((1 + 0.5 * (x[2] / (x[2] + 0.05) - 1)) * (x[3] - x[1]), 2) / pow(list_max(p), 2)]) AS z
    FROM k JOIN f ON f.t = k.t + 1))
SELECT t::BIGINT AS t, i AS pixel, round(v, 6) + 0.0 AS value FROM (SELECT t, unnest(range(64)) AS i, unnest(p) AS v FROM k WHERE t >= 0)""")
def kalman_stack(s, d):
    f = layout.to_frames(cube_events(s, d)).withColumn("seq_id", F.lit("cube"))
    x = tracking.kalman_stack(f).select("t", F.posexplode("data").alias("pixel", "value"))
    return rounded(x.withColumn("pixel", F.col("pixel").cast("long")), "value")


@query(f"""WITH RECURSIVE {CUBE}, w(seq, t, last) AS (SELECT DISTINCT row, -1, [9.0::DOUBLE] FROM cube
  UNION ALL SELECT seq, t, list_append(last, best) FROM (
    SELECT w.seq, c.t, any_value(w.last) AS last, arg_min(c.value, (abs(c.value - list_avg(list_slice(w.last, -5, -1))), c.value)) AS best FROM w JOIN cube c ON c.row = w.seq AND c.t = w.t + 1 GROUP BY w.seq, c.t))
SELECT seq, t::BIGINT AS t, round(last[-1], 6) + 0.0 AS value FROM w WHERE t >= 0""")
def track_nearest(s, d):
    c = cube_events(s, d).select(F.col("row").alias("seq"), "t", "value")
    return rounded(tracking.track_nearest(c, "seq", 9.0), "value")


@query()
def baseline_als(s, d):
    return _cells(tracking.baseline_als(traces_emb(s, d)))


def _spline_sql(n: int = 64, fine: int = 10) -> str:
    """CTEs up to sp (row, col, i, v): the natural spline of traces of n samples on a grid `fine` times finer.

    Its second derivatives m solve m[i-1] + 4 m[i] + m[i+1] = 6 * second differences: one recurrence on, one back.
    """
    return f"""WITH RECURSIVE {TRACES}, dd AS MATERIALIZED (SELECT row, col, t AS j, 6 * (lead(value) OVER w - 2 * value + lag(value) OVER w) AS d FROM tr WINDOW w AS (PARTITION BY row, col ORDER BY t)),
fw(row, col, j, c, e) AS (SELECT row, col, j, 0.25::DOUBLE, d / 4 FROM dd WHERE j = 1 UNION ALL SELECT f.row, f.col, f.j + 1, 1 / (4 - c), (d - e) / (4 - c) FROM fw f JOIN dd ON dd.row = f.row AND dd.col = f.col AND dd.j = f.j + 1 WHERE f.j < {n - 2}),
fm AS MATERIALIZED (FROM fw), mm(row, col, t, m) AS (SELECT row, col, j, e FROM fm WHERE j = {n - 2} UNION ALL SELECT f.row, f.col, f.j, e - c * m FROM mm JOIN fm f ON f.row = mm.row AND f.col = mm.col AND f.j = mm.t - 1),
kn AS MATERIALIZED (SELECT tr.row, tr.col, tr.t, value AS y, coalesce(m, 0) AS m FROM tr LEFT JOIN mm ON tr.row = mm.row AND tr.col = mm.col AND tr.t = mm.t),
sp AS (SELECT a.row, a.col, i, (a.m * pow(w, 3) + b.m * pow(u, 3)) / 6 + (a.y - a.m / 6) * w + (b.y - b.m / 6) * u AS v
  FROM (SELECT i, least(i // {fine}, {n - 2}) AS k, i / {fine}.0::DOUBLE - least(i // {fine}, {n - 2}) AS u, 1 - (i / {fine}.0::DOUBLE - least(i // {fine}, {n - 2})) AS w FROM range({(n - 1) * fine + 1}) r(i)) g JOIN kn a ON a.t = k JOIN kn b ON b.row = a.row AND b.col = a.col AND b.t = k + 1)"""


@query(f"""{_spline_sql()}, e AS (SELECT *, sign(v - lag(v) OVER w) AS a, sign(lead(v) OVER w - v) AS b FROM sp WINDOW w AS (PARTITION BY row, col ORDER BY i))
SELECT row, col, CASE WHEN a > 0 THEN 'max' ELSE 'min' END AS kind, {R.format('i / 10.0::DOUBLE')} AS t, round(v, 6) + 0.0 AS value FROM e WHERE (a > 0 AND b <= 0) OR (a < 0 AND b >= 0)""")
def refined_extrema(s, d):
    return rounded(tracking.refined_extrema(traces_emb(s, d)), "t", "value")


@query(f"{_spline_sql(64, 4)} SELECT row, col, i AS t, {V.replace('value', 'v', 1)} FROM sp")
def interpolate(s, d):
    return _cells(tracking.interpolate(traces_emb(s, d), 4))


@query()
def emd_modes(s, d):
    return tracking.emd(traces_emb(s, d)).select("row", "col", "mode", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


# Rectangles that move, as objects whose links SQL can give too.
OBJ = "obj AS (SELECT t, row * 2 // 3 AS obj, row, col, value FROM cube WHERE value > 65.0)"


@query(f"""WITH {CUBE}, {OBJ}, h AS (SELECT DISTINCT a.t, a.obj, b.t - a.t AS lag, b.t AS t2, b.obj AS obj2 FROM obj a JOIN obj b ON a.row = b.row AND a.col = b.col AND b.t - a.t BETWEEN 1 AND 3),
f AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY t, obj ORDER BY lag) AS r FROM h) WHERE r = 1), pk AS (SELECT t, obj, arg_max(row, (value, -row, -col)) AS pr, arg_max(col, (value, -row, -col)) AS pc FROM obj GROUP BY 1, 2),
n AS (SELECT f.t, f.obj, f.t2, f.obj2, row_number() OVER (PARTITION BY f.t2, f.obj2 ORDER BY (a.pr - b.pr) * (a.pr - b.pr) + (a.pc - b.pc) * (a.pc - b.pc), f.t, f.obj) AS k FROM f JOIN pk a ON f.t = a.t AND f.obj = a.obj JOIN pk b ON f.t2 = b.t AND f.obj2 = b.obj)
SELECT t, obj::BIGINT AS obj, t2, obj2::BIGINT AS obj2 FROM n WHERE k = 1""")
def link_frames(s, d):
    o = cube_events(s, d).filter("value > 65.0").withColumn("obj", F.floor(F.col("row") * 2 / 3))
    return objects.link_frames(o)


@query(_starlet_sql(0) + """, k AS (SELECT t, w, CASE WHEN k < 0 THEN -k - 1 WHEN k >= 64 THEN 127 - k ELSE k END AS k FROM (SELECT t, d + t AS k, w FROM range(64) r(t), (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]::DOUBLE[]) / 16 AS w)))
SELECT row, col, k.t, round(sum(w * value), 6) + 0.0 AS value FROM k JOIN c0 ON c0.t = k.k GROUP BY 1, 2, 3""")
def bspline_smooth(s, d):
    return _cells(wavelet.bspline_smooth(traces_emb(s, d)))



def _pass_sql(source: str, out: str, axis: str, n: int, hole: int, of: str) -> str:
    """A CTE of one pass of the spline along an axis of `source` (t, row, col, value)."""
    k = f"SELECT i, w, CASE WHEN k < 0 THEN (-k) % {n} WHEN k >= {n} THEN {n} - 2 - k % {n} ELSE k END AS k FROM (SELECT i, i + d * {hole} AS k, w FROM range({n}) r(i), (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]::DOUBLE[]) / 16 AS w))"
    keys = ", ".join(f"k.i AS {a}" if a == axis else f"x.{a}" for a in of.split())
    return f"{out} AS MATERIALIZED (SELECT {keys}, sum(w * value) AS value FROM {source} x JOIN ({k}) k ON x.{axis} = k.k GROUP BY 1, 2, 3)"


def _cube_passes(source: str, j: int) -> str:
    return ", ".join(_pass_sql(f"s{j}{'trc'[i - 1]}" if i else source, f"s{j}{'trc'[i]}", axis, n, 2**j, "t row col") for i, (axis, n) in enumerate((("t", 30), ("row", 8), ("col", 8))))


@query(f"""WITH {CUBE}, {_cube_passes('cube', 0)}, {_cube_passes('s0c', 1)}
SELECT 0::BIGINT AS level, t, row, col, {R.format('cube.value - s0c.value')} AS value FROM cube JOIN s0c USING (t, row, col) UNION ALL
SELECT 1, t, row::INTEGER, col::INTEGER, {R.format('s0c.value - s1c.value')} FROM s0c JOIN s1c USING (t, row, col) UNION ALL SELECT 2, t, row::INTEGER, col::INTEGER, {R.format('value')} FROM s1c""")
def starlet3d(s, d):
    return rounded(wavelet.decompose3d(cube_events(s, d), 2, 30), "value")


def _hybrid_sql() -> str:
    """CTEs h1 and h2: what the two levels of the hybrid pyramid leave."""
    out, source = [f"WITH {STACK}"], "st"
    for j, reach in enumerate((2, 4)):
        out.append(_median_sql(j, source, f"q{j}", reach))
        out.append(f"w{j} AS MATERIALIZED (SELECT t, row, col, x.value AS x, q.value AS q, x.value - q.value AS w FROM {source} x JOIN q{j} q USING (t, row, col))")
        out.append(f"d{j} AS (SELECT t, median(w) AS m FROM w{j} WHERE w <> 0 GROUP BY t), n{j} AS (SELECT t, 5 * median(abs(w - m)) / 0.6745::DOUBLE AS th FROM w{j} JOIN d{j} USING (t) WHERE w <> 0 GROUP BY t)")
        out.append(f"g{j} AS MATERIALIZED (SELECT t, row, col, CASE WHEN abs(w) > coalesce(th, 0) THEN q ELSE x END AS value FROM w{j} LEFT JOIN n{j} USING (t))")
        source = f"g{j}"
        for i in range(j + 1):
            for axis in ("row", "col"):
                out.append(_pass_sql(source, f"g{j}{i}{axis}", axis, 8, 2**i, "t row col"))
                source = f"g{j}{i}{axis}"
        out.append(f"h{j + 1} AS (SELECT * FROM {source})")
        source = f"h{j + 1}"
    return ", ".join(out)


@query(f"""{_hybrid_sql()} SELECT t, 0::BIGINT AS level, row, col, {R.format('st.value - h1.value')} AS value FROM st JOIN h1 USING (t, row, col) UNION ALL
SELECT t, 1, row::INTEGER, col::INTEGER, {R.format('h1.value - h2.value')} FROM h1 JOIN h2 USING (t, row, col) UNION ALL SELECT t, 2, row::INTEGER, col::INTEGER, {R.format('value')} FROM h2""")
def hybrid_pyramid2d(s, d):
    return rounded(wavelet.decompose2d(layout.to_frames(stack_emb(s, d)), 2, "hybrid"), "value")


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _samples(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.pmod("user_id", F.lit(8)).alias("key"), "ts", "value")


@query(f"SELECT user_id % 8 AS key, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(value) AS n, {R.format('avg(value)')} AS value FROM events GROUP BY 1, 2")
def event_chunks(s, d):
    return rounded(stateful.chunk_means(_samples(s, d), "6 hours"), "value").withColumn("start", _text("start"))


@query(f"SELECT user_id % 8 AS key, strftime(unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']), '%Y-%m-%d %H:%M:%S.%f') AS start, {R.format('avg(value)')} AS value FROM events GROUP BY 1, 2")
def event_sliding_means(s, d):
    return rounded(stateful.sliding_means(_samples(s, d), "12 hours", "6 hours"), "value").withColumn("start", _text("start"))


@query(f"""WITH g AS (SELECT user_id % 8 AS key, ts, value, coalesce(ts >= lag(ts) OVER w + INTERVAL '1 hour', true) AS new FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts)),
i AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S.%f') AS stop, count(*) AS n, {R.format('max(value)')} AS top FROM i GROUP BY key, k""")
def event_sessions(s, d):
    return rounded(stateful.sessions(_samples(s, d), "1 hour"), "top").withColumns({"start": _text("start"), "stop": _text("stop")})


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT user_id % 8 AS key, ts, value, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, value) AS n FROM events WHERE user_id % 8 IS NOT NULL),
k(key, n, p, e) AS (SELECT DISTINCT key, 0::BIGINT, NULL::DOUBLE, 0.05::DOUBLE FROM x
  UNION ALL SELECT key, n, c, e * (1 - g) + CASE WHEN p <> 0 THEN pow(c - p, 2) / (p * p) ELSE 0 END FROM (
    SELECT k.key, x.n, coalesce(p, value) AS p, e, 1 + 0.5 * (e / (e + 0.05) - 1) AS g, coalesce(p, value) + (1 + 0.5 * (e / (e + 0.05) - 1)) * (value - coalesce(p, value)) AS c FROM k JOIN x ON x.key = k.key AND x.n = k.n + 1))
SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, {R.format('p')} AS value FROM k JOIN x USING (key, n)""")
def event_kalman(s, d):
    return rounded(stateful.kalman(_samples(s, d)), "value").withColumn("ts", _text("ts"))


def _all() -> None:
    from . import details, exchange, structures  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
