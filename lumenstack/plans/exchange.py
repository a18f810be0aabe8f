"""Queries of functions as arguments, of tables that go out to files and come back, and of trackers; registered beside those of `registry`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregate, cluster, graph, layout, maps, tracking, window
from ..sources import images, sinks
from .registry import ROI_TRACE, P, R, V, _points, query, rounded
from .views import CUBE, ROIS, cube_events, rois, table


def _path(s, name: str) -> str:
    return f"{graph.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# Functions of columns where a name would do.


@query(f"WITH {P} SELECT a.id AS a, b.id AS b, {R.format('list_max(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))')} AS distance FROM p a, p b WHERE b.id < 10 AND a.id <> b.id")
def pairwise_by_function(s, d):
    p = _points(s, d)
    return rounded(cluster.pairwise(p, p.filter("id < 10"), lambda x, y: F.array_max(F.zip_with(x, y, lambda v, w: F.abs(v - w)))), "distance")


@query(f"WITH {CUBE} SELECT row, col, {R.format('max(value) - min(value)')} AS value FROM cube GROUP BY row, col")
def project_by_function(s, d):
    return rounded(aggregate.time_project(cube_events(s, d), lambda v: F.max(v) - F.min(v)), "value")


@query(f"""WITH {CUBE}, b AS (SELECT *, avg(value) FILTER (t < 10) OVER (PARTITION BY row, col) AS b FROM cube), n AS (SELECT t, row, col, CASE WHEN abs(b) >= 1e-6 THEN value / b - 1 ELSE 0 END AS value FROM b),
g AS (SELECT t, avg(value) AS s FROM cube GROUP BY t) SELECT row, col, {R.format('sum(value * s) / nullif(sqrt(sum(value * value) * sum(s * s)), 0)')} AS value FROM n JOIN g USING (t) GROUP BY row, col""")
def xcorr_by_function(s, d):
    c = cube_events(s, d)
    signal = c.groupBy("t").agg(F.avg("value").alias("s"))
    cosine = lambda v, w: F.try_divide(F.sum(v * w), F.sqrt(F.sum(v * v) * F.sum(w * w)))
    return rounded(maps.xcorrmap(c, signal, cosine, lambda x: window.dfof(x, ["row", "col"], 10)), "value")


# Out to files and back.


@query(f"{ROI_TRACE} SELECT t, {', '.join(f'''round(max(value) FILTER (tag = '{t}'), 6) + 0.0 AS {t}''' for t in ('r01', 'r02', 'r03', 'r04'))} FROM rt GROUP BY t")
def roi_signals_exported(s, d):
    path = _path(s, "signals")
    sinks.export_roi_signals(cube_events(s, d), rois(s), path)
    x = s.read.csv(path, header=True, nullValue="NA")
    return rounded(x.select(F.col("t").cast("long").alias("t"), *[F.col(c).cast("double").alias(c) for c in x.columns[1:]]), *x.columns[1:])


@query(f"WITH {CUBE}, {ROIS} SELECT tag, t, {R.format('avg(value)')} AS value FROM cube JOIN rois ON (col - cx) * (col - cx) + (row - cy) * (row - cy) <= r * r GROUP BY tag, t")
def rois_exported(s, d):
    path = _path(s, "rois")
    sinks.write_rois(rois(s), path)
    return rounded(aggregate.roi_trace(cube_events(s, d), sinks.read_rois(s, path)), "value")


@query(f"WITH {CUBE} SELECT t, row, col, {V} FROM cube WHERE t >= 3 AND t < 9")
def sequences_exported(s, d):
    path, c = _path(s, "sequences"), cube_events(s, d)
    sinks.write_sequences({"whole": c, "part": layout.crop(c, (3, 9))}, path)
    return rounded(s.read.parquet(path).filter("seq_id = 'part'").select("t", "row", "col", "value"), "value")


@query(f"""WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_extendedprice AS price FROM lineitem), g AS (SELECT *, k - lag(k) OVER (ORDER BY k) AS gap FROM x), m AS (SELECT arg_max(k, (coalesce(gap, -1), k)) AS edge FROM g)
SELECT k::DOUBLE AS k, {R.format('price')} AS price, (k >= edge)::INTEGER AS part FROM g, m""")
def lasaf_exported(s, d):
    """One export of numbered readings in part files, decimal commas and all, cut at its widest gap (the last of equal ones)."""
    path = _path(s, "lasaf")
    x = table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_extendedprice").alias("price"))
    x.select(*[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in x.columns]).write.csv(path, sep=";", header=True)
    return rounded(images.read_lasaf(s, path, parts=True), "price")


# Trackers.


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id % 10 AS key, vec_id // 10 AS t, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS n FROM embeddings),
s AS MATERIALIZED (SELECT *, greatest(list_max(v) / greatest(sqrt(greatest(list_avg(list_transform(v, lambda y: y * y)) - list_avg(v) * list_avg(v), 0)), 1e-9), 1e-9) AS snr FROM x),
k(key, n, mu, delta) AS (SELECT DISTINCT key, 0::BIGINT, 30.0::DOUBLE, 0.0::DOUBLE FROM s UNION ALL SELECT key, n, w * mu + (1 - w) * z, w * mu + (1 - w) * z - mu FROM (
  SELECT k.key, s.n, mu, (1 + snr) / (1 + snr / 0.25) AS w, list_position(e, list_max(e)) - 1 AS z FROM (
    SELECT k.key, s.n, mu, snr, list_transform(list_zip(range(len(v)), v), lambda y: exp(-pow(y[1] - mu, 2) / (2 * (4.0 + delta * delta + 1 / (snr * snr)))) * y[2]) AS e FROM k JOIN s ON s.key = k.key AND s.n = k.n + 1) k JOIN s ON s.key = k.key AND s.n = k.n))
SELECT key, t, {R.format('mu')} AS value FROM k JOIN s USING (key, n)""".replace("(1 + snr) / (1 + snr / 0.25) AS w", "(1 + s.snr) / (1 + s.snr / 0.25) AS w"))
def track_kalman(s, d):
    x = table(s, d, "embeddings").select(F.pmod("vec_id", F.lit(10)).alias("key"), F.floor(F.col("vec_id") / 10).alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return rounded(tracking.track_kalman(x, "key", 30.0), "value")


@query(f"""WITH p AS (SELECT l_returnflag AS key, l_quantity AS x, min(date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + l_quantity * 10)::DOUBLE AS t FROM lineitem GROUP BY 1, 2), a AS (SELECT key, arg_min(x, (t, x)) AS x0 FROM p GROUP BY key),
r AS (SELECT key, sign(x - x0)::INTEGER AS side, abs(x - x0) AS r, t FROM p JOIN a USING (key) WHERE x <> x0), v AS (SELECT key, side, r, abs((lead(r) OVER w - lag(r) OVER w) / nullif(lead(t) OVER w - lag(t) OVER w, 0)) AS velocity FROM r WINDOW w AS (PARTITION BY key, side ORDER BY r))
SELECT key, side, r, {R.format('velocity')} AS velocity FROM v WHERE r >= 5 AND velocity IS NOT NULL""")
def front_velocity(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("x"))
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01")))
    return rounded(tracking.front_velocity(x.agg(F.min(day + F.col("l_quantity") * 10).cast("double").alias("t")), "key"), "velocity")
