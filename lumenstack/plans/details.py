"""Queries of the smaller operators, with their SQL; registered beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import aggregate, cluster, layout, maps, spatial, wavelet, window
from .registry import DIST, IMG, MAD_SQL, PX, REG, ROI_TRACE, P, R, V, _bin, _cells, _img, _points, _seeds, _starlet_sql, query, rounded
from .views import CUBE, STACK, TRACES, cube_events, rois, stack_emb, trace_cells, traces_emb

# Aggregates and time.

SNR = """{0}q AS (SELECT row, col, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS q2 FROM {1} GROUP BY row, col),
{0}s AS (SELECT row, col, avg(value) FILTER (value > q3) / (stddev_pop(value) FILTER (value <= q2) + 1) AS s FROM {1} JOIN {0}q USING (row, col) GROUP BY row, col)"""


@query(f"""WITH {TRACES}, neg AS (SELECT t, row, col, -value AS value FROM tr), {SNR.format('u', 'tr')}, {SNR.format('d', 'neg')},
b AS (SELECT row, col, greatest(abs(us.s), abs(ds.s)) AS v FROM us JOIN ds USING (row, col))
SELECT row, col, {R.format('v / (SELECT avg(v) FROM b)')} AS value FROM b""")
def simple_snr2(s, d):
    return rounded(aggregate.simple_snr2(trace_cells(s, d)), "value")


@query(f"WITH {CUBE} SELECT t, row, col, round(value / nullif(avg(value) OVER (PARTITION BY row, col), 0) - 1, 6) + 0.0 AS value FROM cube")
def over_mean_frame(s, d):
    return rounded(window.over_mean_frame(cube_events(s, d)), "value")


@query(f"WITH {CUBE} SELECT t, row, col, {V} FROM cube WHERE value >= 0 AND value <= 40.5")
def limit_bounds(s, d):
    return rounded(window.limit_bounds(cube_events(s, d), 0, 40.5), "value")


@query(f"WITH {TRACES}, m AS (SELECT row, col, median(value) AS m FROM tr GROUP BY 1, 2) SELECT row, col, {R.format('median(abs(value - m))')} AS mad FROM tr JOIN m USING (row, col) GROUP BY 1, 2")
def trace_mad(s, d):
    return rounded(aggregate.mad(trace_cells(s, d), PX), "mad")


@query(_starlet_sql(3) + f" SELECT row, col, t, {R.format('CASE WHEN abs(c3.value) >= 1e-6 THEN c0.value / c3.value - 1 ELSE 0 END')} AS value FROM c0 JOIN c3 USING (row, col, t)")
def starlet_dfof(s, d):
    return _cells(wavelet.dfof1d(traces_emb(s, d), 3))


@query(_starlet_sql(3) + f", {MAD_SQL} SELECT row, col, t, {R.format('CASE WHEN sigma <> 0 THEN (c1.value - c3.value) / sigma ELSE 0 END')} AS value FROM c1 JOIN c3 USING (row, col, t) JOIN sg USING (row, col)")
def starlet_dfosd(s, d):
    """Without the finest level: the approximation of one level less that of three."""
    return _cells(wavelet.dfosd1d(traces_emb(s, d), 3, 1))


def _local_std_sql() -> str:
    again = _starlet_sql(1, "tr AS (SELECT row, col, t, pow(c0.value - c1.value, 2) AS value FROM c0 JOIN c1 USING (row, col, t))").removeprefix("WITH ")
    again = again.replace("tr AS", "sq AS", 1).replace("FROM tr)", "FROM sq)").replace("c0 AS", "e0 AS").replace("FROM k0 JOIN c0 ON c0.t", "FROM q0 JOIN e0 ON e0.t").replace("k0 AS", "q0 AS").replace("q0.t", "q0.t").replace("k0.", "q0.").replace("c1 AS", "e1 AS")
    return _starlet_sql(1) + ", " + again + f" SELECT row, col, t, {R.format('sqrt(greatest(value, 0))')} AS value FROM e1"


@query(_local_std_sql())
def starlet_local_std(s, d):
    return _cells(wavelet.local_std1d(traces_emb(s, d), 1))


#: The details of two levels beside the noise.
DETAILS = _starlet_sql(2).replace("WITH ", "WITH RECURSIVE ", 1) + f", {MAD_SQL}, dt AS MATERIALIZED (SELECT row, col, t, c0.value - c2.value AS r, c0.value - c1.value AS w0, c1.value - c2.value AS w1, c2.value AS c, sigma FROM c0 JOIN c1 USING (row, col, t) JOIN c2 USING (row, col, t) JOIN sg USING (row, col))"
SOFT = "CASE WHEN abs({0}) > {1} * sigma THEN {0} - sign({0}) * {1} * sigma ELSE 0 END"


@query(f"{DETAILS} SELECT row, col, t, {R.format('c + ' + SOFT.format('w0', '0.7235::DOUBLE') + ' + ' + SOFT.format('w1', '0.2854::DOUBLE'))} AS value FROM dt")
def starlet_denoise_soft(s, d):
    return _cells(wavelet.denoise1d(traces_emb(s, d), 2, 1.0, soft=True))


@query(f"""{DETAILS}, it(row, col, i, s, done) AS (SELECT row, col, 0, sigma, false FROM sg
  UNION ALL SELECT row, col, i + 1, n, abs(n - s) <= 0.01 * n FROM (
    SELECT it.row, it.col, any_value(i) AS i, any_value(s) AS s, coalesce(stddev_pop(CASE WHEN abs(w0) <= 3 * 0.7235::DOUBLE * s AND abs(w1) <= 3 * 0.2854::DOUBLE * s THEN r END), any_value(s)) AS n
    FROM it JOIN dt ON it.row = dt.row AND it.col = dt.col WHERE NOT done AND i < 20 GROUP BY it.row, it.col))
SELECT row, col, {R.format('arg_max(s, i)')} AS sigma FROM it GROUP BY 1, 2""")
def estimate_sigma(s, d):
    return rounded(wavelet.estimate_sigma(traces_emb(s, d), 2).select("row", "col", "sigma"), "sigma")


# Regions, boxes and geometry.


@query(f"{REG}, st AS (SELECT t, region, count(*) AS n FROM reg GROUP BY 1, 2), l AS (SELECT t, x.region, sqrt(max((x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col))) AS l FROM reg x JOIN reg y USING (t, region) GROUP BY 1, 2) SELECT t, row, col, region FROM reg JOIN st USING (t, region) JOIN l USING (t, region) WHERE l > 1.1 * sqrt(n)")
def filter_shape(s, d):
    return spatial.filter_shape(spatial.regions(_bin(s, d), 8, 8), 1.1)


@query(f"{REG} SELECT t, row, col FROM reg SEMI JOIN (SELECT t, region FROM reg GROUP BY 1, 2 HAVING count(*) > 3) USING (t, region)")
def filter_mask(s, d):
    return spatial.filter_mask(_bin(s, d), 8, 8, lambda x: spatial.filter_size(x, 3))


@query(f"{REG}, c AS (SELECT t, region, avg(row) AS r, avg(col) AS c FROM reg GROUP BY 1, 2) SELECT t, x.region AS a, y.region AS b, {R.format('sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2))')} AS distance FROM c x JOIN c y USING (t) WHERE x.region < y.region")
def region_centre_distances(s, d):
    return rounded(spatial.region_centre_distances(spatial.regions(_bin(s, d), 8, 8)), "distance")


@query(f"{REG}, n AS (SELECT t, x.region AS a, y.region AS b FROM reg x JOIN reg y USING (t) WHERE x.region < y.region AND (x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col) < 4 GROUP BY 1, 2, 3), e AS (SELECT t, a, b FROM n UNION ALL SELECT t, b, a FROM n), "
       "g(t, node, root) AS (SELECT DISTINCT t, region, region FROM reg UNION SELECT g.t, e.b, g.root FROM g JOIN e ON e.t = g.t AND e.a = g.node WHERE g.root < e.b), m AS (SELECT t, node AS region, min(root) AS root FROM g GROUP BY 1, 2) SELECT t, row, col, root AS region FROM reg JOIN m USING (t, region)")
def glue_regions(s, d):
    return spatial.glue_regions(spatial.regions(_bin(s, d), 8, 8), 2)


BOX = "bx AS (SELECT t, region, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1 FROM reg GROUP BY 1, 2)"


@query(f"{REG.replace('65.0', '40.0')}, {BOX} SELECT t, x.region AS a, y.region AS b FROM bx x JOIN bx y USING (t) WHERE x.region < y.region AND greatest(x.r0, y.r0) < least(x.r1, y.r1) AND greatest(x.c0, y.c0) < least(x.c1, y.c1)")
def boxes_meet(s, d):
    b = spatial.boxes(spatial.regions(cube_events(s, d).filter("value > 40.0"), 8, 8))
    return spatial.boxes_meet(b, b).filter("a < b")


ABOVE = "ab AS (SELECT t, row, col, CASE WHEN value > 65.0 THEN value ELSE 0.0 END AS value FROM cube), hit AS (SELECT t, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1 FROM ab WHERE value <> 0 GROUP BY t)"


def _above(s, d) -> DataFrame:
    return cube_events(s, d).withColumn("value", F.when(F.col("value") > 65.0, F.col("value")).otherwise(0.0))


@query(f"WITH {CUBE}, {ABOVE} SELECT t, (row - r0)::INTEGER AS row, (col - c0)::INTEGER AS col, {V} FROM ab JOIN hit USING (t) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
def embed_frames(s, d):
    return rounded(spatial.embed(_above(s, d))[0], "value")


@query(f"WITH {CUBE}, {ABOVE} SELECT t, row, col, {V} FROM ab SEMI JOIN hit USING (t)")
def embed_round_trip(s, d):
    return rounded(spatial.unembed(*spatial.embed(_above(s, d)), 8, 8), "value")


@query(f"WITH {CUBE}, {IMG} SELECT row, col, {R.format('col / 8.0::DOUBLE')} AS x, {R.format('row / 8.0::DOUBLE')} AS y, round((value - a) / (b - a), 6) + 0.0 AS z FROM img, (SELECT min(value) AS a, max(value) AS b FROM img) WHERE NOT value > 45.0")
def surface_points(s, d):
    img = _img(s, d)
    return rounded(spatial.surface_points(img, img.filter("value > 45.0")), "x", "y", "z")


@query("SELECT user_id % 12 - 2 AS row, user_id % 11 - 1 AS col, count(*) AS n FROM events WHERE user_id % 12 - 2 BETWEEN 0 AND 7 AND user_id % 11 - 1 BETWEEN 0 AND 7 GROUP BY 1, 2")
def places_in_frame(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select((F.pmod("user_id", F.lit(12)) - 2).alias("row"), (F.pmod("user_id", F.lit(11)) - 1).alias("col"))
    return e.filter(spatial.in_frame(F.col("row"), F.col("col"), 8, 8)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STACK}, g AS (SELECT i, j, floor(i * 7 / 5.0)::INTEGER AS r, floor(j * 7 / 6.0)::INTEGER AS c, i * 7 / 5.0::DOUBLE - floor(i * 7 / 5.0) AS u, j * 7 / 6.0::DOUBLE - floor(j * 7 / 6.0) AS v FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(6)) AS j)),
k AS (SELECT i, j, least(r + a, 7) AS row, least(c + b, 7) AS col, (CASE WHEN a = 1 THEN u ELSE 1 - u END) * (CASE WHEN b = 1 THEN v ELSE 1 - v END) AS w FROM g, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT t, i::INTEGER AS row, j::INTEGER AS col, {R.format('sum(w * value)')} AS value FROM k JOIN st USING (row, col) GROUP BY 1, 2, 3""")
def resize_frames(s, d):
    return rounded(spatial.resize(stack_emb(s, d), 5, 6), "value")


@query(f"WITH {CUBE} SELECT t, floor((col - 1) * 0.8::DOUBLE + row * 0.6::DOUBLE + 0.5)::BIGINT AS i, {R.format('avg(value)')} AS value FROM cube WHERE value > 0 GROUP BY 1, 2")
def line_projection(s, d):
    return rounded(spatial.line_projection(cube_events(s, d), (1, 0, 5, 3)), "value")


@query(f"WITH {CUBE} SELECT t, i, {R.format('avg(value)')} AS value FROM cube JOIN (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {c})" for k in (-1, 0, 1) for i, r, c in spatial.line_samples(0, 4 + k, 7, 4 + k)) + ") v(i, row, col)) USING (row, col) GROUP BY 1, 2")
def zview(s, d):
    return rounded(spatial.zview(cube_events(s, d), (0, 4, 7, 4), 1), "value").withColumn("i", F.col("i").cast("int"))


@query(f"WITH {CUBE} SELECT tr, tc, t, {R.format('avg(value)')} AS value, count(*) AS n FROM (SELECT unnest([0, 1, 2]) AS tr), (SELECT unnest([0, 1, 2]) AS tc), cube WHERE row BETWEEN tr * 3 AND tr * 3 + 3 AND col BETWEEN tc * 3 AND tc * 3 + 3 GROUP BY 1, 2, 3")
def tile_means(s, d):
    x = spatial.tiles(cube_events(s, d), 4, 3).groupBy("tr", "tc", "t").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return rounded(x, "value").withColumns({"tr": F.col("tr").cast("int"), "tc": F.col("tc").cast("int")})


@query(f"WITH {CUBE} SELECT t, count(*) AS n, {R.format('avg(value)')} AS value FROM cube WHERE row >= 1 AND row <= 5 AND col >= 2 AND col <= 6 GROUP BY t")
def polygon_means(s, d):
    inside = spatial.in_polygon(F.col("row"), F.col("col"), [(0.5, 1.5), (0.5, 6.5), (5.5, 6.5), (5.5, 1.5)])
    return rounded(cube_events(s, d).filter(inside).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query(f"""WITH {CUBE}, n AS (SELECT x.t, x.row, x.col, any_value(x.value) AS v, median(y.value) AS q FROM cube x JOIN cube y ON x.t = y.t AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1 GROUP BY 1, 2, 3),
m AS (SELECT t, median(v - q) AS m FROM n GROUP BY t), sd AS (SELECT t, median(abs(v - q - m)) / 0.6745::DOUBLE AS s FROM n JOIN m USING (t) GROUP BY t)
SELECT t, row, col, round(CASE WHEN abs(v - q) <= 1.5 * s THEN v ELSE q END, 6) + 0.0 AS value FROM n JOIN sd USING (t)""")
def adaptive_median_mad(s, d):
    return rounded(spatial.adaptive_median_mad(cube_events(s, d), 1.5), "value")


@query(f"""WITH {CUBE}, m AS (SELECT t, covar_pop(col, col) AS cc, covar_pop(row, row) AS rr, covar_pop(row, col) AS rc, covar_pop(col, value) AS cv, covar_pop(row, value) AS rv, avg(col) AS mc, avg(row) AS mr, avg(value) AS mv FROM cube GROUP BY t),
p AS (SELECT *, (cv * rr - rv * rc) / (cc * rr - rc * rc) AS a, (rv * cc - cv * rc) / (cc * rr - rc * rc) AS b FROM m)
SELECT t, row, col, round(value - a * (col - mc) - b * (row - mr) - mv, 6) + 0.0 AS value FROM cube JOIN p USING (t)""")
def remove_plane(s, d):
    return rounded(spatial.remove_plane(cube_events(s, d)), "value")


# Spectra of regions.


@query(f"{ROI_TRACE}, z AS (SELECT tag, t, value - avg(value) OVER (PARTITION BY tag) AS v FROM rt) SELECT tag, k::INTEGER AS k, round(pow(sum(v * cos(2 * pi() * k * t / 30)), 2) + pow(sum(v * sin(2 * pi() * k * t / 30)), 2), 4) + 0.0 AS power FROM z, (SELECT unnest(range(1, 16)) AS k) GROUP BY 1, 2")
def roi_spectra(s, d):
    x = maps.spectra(aggregate.roi_trace(cube_events(s, d), rois(s)), ["tag"], 30)
    return x.withColumn("power", F.round("power", 4) + 0.0)


@query(f"""{ROI_TRACE}, w AS (SELECT tag, g AS wn, t - g * 5 AS t, value FROM rt, (SELECT unnest(range(6)) AS g) WHERE t >= g * 5 AND t < g * 5 + 10), z AS (SELECT tag, wn, t, value - avg(value) OVER (PARTITION BY tag, wn) AS v FROM w WHERE wn <= 4)
SELECT tag, wn AS part, k::INTEGER AS k, round(pow(sum(v * cos(2 * pi() * k * t / 10)), 2) + pow(sum(v * sin(2 * pi() * k * t / 10)), 2), 4) + 0.0 AS power FROM z, (SELECT unnest(range(1, 6)) AS k) GROUP BY 1, 2, 3""")
def roi_spectrograms(s, d):
    x = maps.spectrograms(aggregate.roi_trace(cube_events(s, d), rois(s)), ["tag"], 10, 5)
    return x.withColumn("power", F.round("power", 4) + 0.0)


# Distances and clusters.


def _distance_sql(body: str, before: str = "") -> str:
    moments = "(SELECT avg(z[1]) AS ma, avg(z[2]) AS mb, corr(z[1], z[2]) AS r, sum(z[1] * z[2]) AS dot, sum(abs(z[1] - z[2])) AS l1, pow(sum(pow(abs(z[1] - z[2]), 3)), 1 / 3.0::DOUBLE) AS l3 FROM (SELECT unnest(list_zip(a.x, b.x)) AS z))"
    return f"WITH {P}{before} SELECT a.id AS a, b.id AS b, {R.format(body)} AS distance FROM p a, p b, LATERAL {moments} m WHERE b.id < 5 AND a.id <> b.id"


def _distances(s, d, how: str) -> DataFrame:
    p = _points(s, d)
    return rounded(cluster.pairwise(p, p.filter("id < 5"), how), "distance")


@query(_distance_sql("l1"))
def dist_cityblock(s, d):
    return _distances(s, d, "cityblock")


@query(_distance_sql("1 - r"))
def dist_pearson(s, d):
    return _distances(s, d, "pearson")


@query(_distance_sql("1 - abs(r)"))
def dist_apearson(s, d):
    return _distances(s, d, "apearson")


@query(_distance_sql("1 / dot"))
def dist_xcorr(s, d):
    return _distances(s, d, "xcorr")


@query(_distance_sql("l3"))
def dist_minkowski3(s, d):
    p = _points(s, d)
    q = p.filter("id < 5").select(F.col("id").alias("b"), F.col("x").alias("y"))
    return rounded(p.crossJoin(F.broadcast(q)).filter("id <> b").select(F.col("id").alias("a"), "b", cluster.minkowski(F.col("x"), F.col("y"), 3).alias("distance")), "distance")


@query(f"""WITH {P}, u AS (SELECT id, unnest(range(len(x))) AS i, unnest(x) AS v FROM p), rk AS (SELECT id, i, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0::DOUBLE AS r FROM u)
SELECT a.id AS a, b.id AS b, {R.format('1 - corr(a.r, b.r)')} AS distance FROM rk a JOIN rk b USING (i) WHERE b.id < 5 AND a.id <> b.id GROUP BY 1, 2""")
def dist_spearman(s, d):
    return _distances(s, d, "spearman")


NEAREST = f"w AS MATERIALIZED (SELECT id, x, label, d FROM (SELECT a.id, a.x, b.id AS label, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS n FROM p a, p b WHERE b.id < 10) WHERE n = 1)"


def _won(s, d) -> DataFrame:
    p = _points(s, d)
    return cluster.assign(p, _seeds(p, 10))


@query(f"WITH {P}, {NEAREST} SELECT label, count(*) AS mass, {R.format('avg(d)')} AS distortion, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM w GROUP BY label")
def clusters_by_mass(s, d):
    return rounded(cluster.top_by_mass(cluster.cluster_stats(_won(s, d))), "distortion")


@query(f"WITH {P}, {NEAREST} SELECT a.label, {R.format(f'max({DIST})')} AS diameter FROM w a JOIN w b USING (label) GROUP BY 1")
def cluster_diameters(s, d):
    return rounded(cluster.diameters(_won(s, d)), "diameter")


@query(f"WITH {P}, {NEAREST} SELECT a.label, b.id AS b, {R.format(f'max({DIST})')} AS distance FROM w a, p b WHERE b.id < 3 GROUP BY 1, 2")
def farthest_linkage(s, d):
    return rounded(cluster.farthest(_won(s, d), _points(s, d).filter("id < 3")), "distance")


@query(f"WITH {P}, {NEAREST} SELECT id, {R.format('d')} AS distance FROM w WHERE label = 3")
def select_points(s, d):
    return rounded(cluster.select_points(_won(s, d), 3).select("id", "distance"), "distance")


# Objects, as blobs of the cube.


@query(f"""WITH {CUBE}, o AS (SELECT t, row * 2 // 3 AS obj, row, col, value FROM cube WHERE value > 65.0)
SELECT t, obj::BIGINT AS obj, count(*) AS npixels, {R.format('sum(value)')} AS energy, {R.format('count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1))::DOUBLE')} AS density FROM o GROUP BY 1, 2""")
def object_stats(s, d):
    from ..operators import objects

    o = cube_events(s, d).filter("value > 65.0").withColumn("obj", F.floor(F.col("row") * 2 / 3))
    return rounded(objects.object_stats(o), "energy", "density")


# Curves and small functions.

LINES = "x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_discount AS f FROM lineitem)"


def _lines(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("f"))


@query(f"""WITH {LINES} SELECT k, n, {R.format('3 * exp(-pow(q - 20, 2) / (2 * 36))')} AS gaussian, {R.format('1 + 2 * exp(-q / 7)')} AS decaying_exp, {R.format('1 - 2 * exp(-q / 7)')} AS rising_exp, {R.format('5 - 2 * exp(-q / 7) - exp(-q / 30)')} AS double_rising_exp,
{R.format('4 / (1 + 9 * exp(-q / 5))')} AS logistic, {R.format('4 - 3 * pow(q, -1.5)')} AS rising_pow, {R.format('4 * q / (6 + pow(q, 1.2))')} AS michaelis_menten, {R.format('2 * sqrt(2 * ln(2)) * q')} AS fwhm FROM x""")
def curve_values(s, d):
    q = F.col("q")
    x = _lines(s, d).select(
        "k", "n", curves.gaussian(q, 3, 20, 6).alias("gaussian"), curves.decaying_exp(q, 1, 2, 7).alias("decaying_exp"), curves.rising_exp(q, 1, 2, 7).alias("rising_exp"), curves.double_rising_exp(q, 5, 2, 1, 7, 30).alias("double_rising_exp"),
        curves.logistic(q, 4, 9, 5).alias("logistic"), curves.rising_pow(q, 4, 3, 1.5).alias("rising_pow"), curves.michaelis_menten(q, 4, 6, 1.2).alias("michaelis_menten"), curves.fwhm(q).alias("fwhm"),
    )
    return rounded(x, *x.columns[2:])


@query(f"WITH {LINES} SELECT k, n, {R.format('0.5 * (1 + tanh(10 * (q - 20) / 10)) * exp(-abs(q - 20) / 10)')} AS spike, {R.format('least(q % 7, 7 - q % 7)')} AS alias, {R.format('(k * 4294967296.0::DOUBLE + n) / 10000')} AS ms, 'r' || lpad(n::VARCHAR, 2, '0') AS tag FROM x WHERE k < 5000")
def small_functions(s, d):
    q = F.col("q")
    x = _lines(s, d).filter("k < 5000").select("k", "n", curves.tanh_spike(q, 20).alias("spike"), curves.alias_freq(q, 7.0).alias("alias"), curves.ticks_to_ms(F.col("k"), F.col("n")).alias("ms"), curves.roi_tag(F.col("n")).alias("tag"))
    return rounded(x, "spike", "alias", "ms")


@query("SELECT name, row_number() OVER (ORDER BY regexp_replace(name, '[0-9]+$', ''), regexp_extract(name, '[0-9]+$')::BIGINT) AS rank FROM (SELECT DISTINCT event_type || user_id::VARCHAR AS name FROM events)")
def natural_order(s, d):
    from pyspark.sql import Window

    e = s.read.parquet(f"{d}/events.parquet").select(F.concat("event_type", F.col("user_id").cast("string")).alias("name")).distinct()
    return e.withColumn("rank", F.row_number().over(Window.orderBy(curves.natural_key(F.col("name")))).cast("long"))


@query("SELECT event_id, strftime(TIMESTAMP '1899-12-30' + INTERVAL 1 SECOND * (user_id * 5400), '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def excel_times(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.date_format(curves.excel_time(F.col("user_id") / 16), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


# Layout and files.


@query(f"WITH {STACK} SELECT t, row, col, round(value::FLOAT::DOUBLE, 6) + 0.0 AS value FROM st")
def tiff_round_trip(s, d):
    """Every frame as the bytes of a TIFF file, and read back."""
    import numpy as np
    import pandas as pd

    from ..sources import sinks, tiff

    def run(batches):
        for b in batches:
            images = [next(tiff.read_images(c)) for c in b["content"]]
            yield pd.DataFrame({"t": b["t"], "h": [x.shape[0] for x in images], "w": [x.shape[1] for x in images], "data": [np.asarray(x, float).ravel() for x in images]})

    frames = sinks.to_tiff(layout.to_frames(stack_emb(s, d))).mapInPandas(run, "t long, h int, w int, data array<double>")
    return rounded(layout.frames_to_cells(frames), "value")


@query(f"WITH {CUBE}, k AS (SELECT t, row, col, value FROM cube WHERE value > 30.0), g AS (SELECT t, max(row) AS h, max(col) AS w FROM k GROUP BY t) SELECT c.t, c.row, c.col, round(coalesce(k.value, -1), 6) + 0.0 AS value FROM cube c JOIN g ON c.t = g.t AND c.row <= h AND c.col <= w LEFT JOIN k ON k.t = c.t AND k.row = c.row AND k.col = c.col")
def frames_filled(s, d):
    return rounded(layout.frames_to_cells(layout.to_frames(cube_events(s, d).filter("value > 30.0"), -1.0)), "value")


@query(f"WITH {CUBE}, m AS (SELECT row, col FROM cube GROUP BY 1, 2 HAVING max(value) > 90) SELECT t, row, col, {V} FROM cube ANTI JOIN m USING (row, col) UNION ALL SELECT t, row, col, 0.0 FROM cube SEMI JOIN m USING (row, col)")
def zero_where(s, d):
    from ..operators import masks

    c = cube_events(s, d)
    return rounded(masks.zero_where(c, aggregate.max_project(c).filter("value > 90")).select("t", "row", "col", "value"), "value")


@query(f"WITH {CUBE} SELECT row, col FROM cube GROUP BY 1, 2 HAVING avg(value) > 48 OR max(value) > 95")
def mask_union(s, d):
    from ..operators import masks

    c = cube_events(s, d)
    return masks.union(aggregate.mean_frame(c).filter("value > 48"), aggregate.max_project(c).filter("value > 95"))


@query(f"WITH {TRACES}, r AS (SELECT * FROM (VALUES ('a', 2.0::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE)) v(tag, cx, cy, rr)) SELECT tag, t, {R.format('avg(value)')} AS value FROM tr JOIN r ON (col - cx) * (col - cx) + (row - cy) * (row - cy) <= rr * rr GROUP BY 1, 2")
def roi_of_traces(s, d):
    return rounded(aggregate.roi_trace(trace_cells(s, d), s.createDataFrame([("a", 2.0, 1.0, 1.5)], rois(s).schema)), "value")


@query(f"{ROI_TRACE} SELECT t, " + ", ".join(f"round(max(value) FILTER (tag = '{t}'), 6) + 0.0 AS {t}" for t in ("r01", "r02", "r03", "r04")) + " FROM rt GROUP BY t")
def wide_table(s, d):
    from ..sources import sinks

    x = sinks.wide(aggregate.roi_trace(cube_events(s, d), rois(s)), ["r01", "r02", "r03", "r04"])
    return rounded(x, *x.columns[1:])


@query(f"WITH {CUBE}, q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM cube) SELECT t, row, col, {R.format('greatest(0, least(1, (value - a) / (b - a)))')} AS value FROM cube, q")
def display_range(s, d):
    from ..sources import sinks

    return rounded(sinks.lut(cube_events(s, d)), "value")


@query(f"WITH {CUBE} SELECT (t // 3)::BIGINT AS t, (t % 3)::INTEGER AS ch, row, col, {V} FROM cube")
def unmix_planes(s, d):
    from ..sources import images

    return rounded(images.unmix_planes(cube_events(s, d), 3), "value").select("t", "ch", "row", "col", "value")


@query(f"WITH {CUBE} SELECT (t * 4 + col // 2 - 1)::BIGINT AS t, row, (col % 2)::INTEGER AS col, {V} FROM cube WHERE t = 0 AND col >= 2")
def cut_strip(s, d):
    from ..sources import images

    return rounded(images.cut_strip(cube_events(s, d).filter("t = 0"), 2), "value").select("t", "row", "col", "value")


@query("SELECT name, t, c FROM (SELECT DISTINCT 's' || user_id::VARCHAR || '_t' || (user_id % 9)::VARCHAR || '_c' || (user_id % 2)::VARCHAR || '.tif' AS name, user_id % 9 AS t, user_id % 2 AS c FROM events)")
def axes_of_names(s, d):
    from ..sources import images

    u = F.col("user_id")
    e = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("dir/s"), u.cast("string"), F.lit("_t"), (u % 9).cast("string"), F.lit("_c"), (u % 2).cast("string"), F.lit(".tif")).alias("path")).distinct()
    return images.axes_of_names(e, r"_t(\d+)_c(\d+)\.tif$", ["t", "c"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "t", "c")


# Registration and tracks.


@query(f"WITH {CUBE} SELECT c.t, c.row, c.col, {R.format('s.value')} AS value FROM cube c JOIN cube s ON s.t = c.t AND s.row = greatest(c.row - CASE WHEN c.t % 2 = 0 THEN 1 ELSE 0 END, 0) AND s.col = least(c.col + CASE WHEN c.t % 2 = 0 THEN 2 ELSE 0 END, 7)")
def apply_warps(s, d):
    """Even frames moved by whole pixels; the others have no warp."""
    from ..operators import register

    warps = s.range(0, 30, 2).select(F.col("id").alias("t"), F.lit("shift").alias("model"), F.array(F.lit(1.0), F.lit(-2.0)).alias("params"))
    return rounded(layout.frames_to_cells(register.apply_warps(layout.to_frames(cube_events(s, d)), warps)), "value")


@query(f"""WITH RECURSIVE {CUBE}, obj AS (SELECT t, row * 2 // 3 AS obj, row, col, value FROM cube WHERE value > 65.0), h AS (SELECT DISTINCT a.t, a.obj, b.t - a.t AS lag, b.t AS t2, b.obj AS obj2 FROM obj a JOIN obj b ON a.row = b.row AND a.col = b.col AND b.t - a.t BETWEEN 1 AND 3),
f AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY t, obj ORDER BY lag) AS r FROM h) WHERE r = 1), pk AS (SELECT t, obj, arg_max(row, (value, -row, -col)) AS pr, arg_max(col, (value, -row, -col)) AS pc FROM obj GROUP BY 1, 2),
n AS (SELECT f.t, f.obj, f.t2, f.obj2, row_number() OVER (PARTITION BY f.t2, f.obj2 ORDER BY (a.pr - b.pr) * (a.pr - b.pr) + (a.pc - b.pc) * (a.pc - b.pc), f.t, f.obj) AS k FROM f JOIN pk a ON f.t = a.t AND f.obj = a.obj JOIN pk b ON f.t2 = b.t AND f.obj2 = b.obj),
o AS (SELECT DISTINCT t, obj, t * (SELECT max(obj) + 1 FROM obj) + obj AS id FROM obj), l AS (SELECT x.id AS a, y.id AS b FROM n JOIN o x ON x.t = n.t AND x.obj = n.obj JOIN o y ON y.t = n.t2 AND y.obj = n.obj2 WHERE k = 1), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
w(node, root) AS (SELECT id, id FROM o UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node WHERE w.root < e.b), c AS (SELECT node, min(root) AS track FROM w GROUP BY node), x AS (SELECT track, t, obj, min(t) OVER (PARTITION BY track) AS first, max(t) OVER (PARTITION BY track) AS last FROM o JOIN c ON c.node = o.id)
SELECT track::BIGINT AS track, t, obj::BIGINT AS obj, first, last FROM x WHERE last - first + 1 >= 5""")
def linked_objects(s, d):
    from ..operators import objects

    o = cube_events(s, d).filter("value > 65.0").withColumn("obj", F.floor(F.col("row") * 2 / 3))
    return objects.linked_objects(o, 5)


# Algebra: what must hold of the axes.


@query("SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM range(6) a(i), range(6) b(j)")
def whitening(s, d):
    """The covariance of whitened points: 1 on the diagonal, 0 elsewhere."""
    from ..operators import linalg

    p = _points(s, d)
    mean, white = linalg.whitening(p, 6)
    x = linalg.project(p, mean, white).select(F.posexplode("p").alias("i", "v"), "p").select("i", "v", F.posexplode("p").alias("j", "w"))
    c = x.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.covar_pop("v", "w").alias("value"))
    return rounded(c, "value")


@query(f"WITH {P} SELECT {R.format('sum(v)')} AS total FROM (SELECT var_pop(x) AS v FROM (SELECT unnest(range(len(x))) AS i, unnest(x) AS x FROM p) GROUP BY i)")
def pca_total_variance(s, d):
    from ..operators import linalg

    return s.createDataFrame([(round(float(linalg.pca(_points(s, d), 64)[2].sum()), 6),)], "total double")


@query(f"WITH {TRACES}, a AS (SELECT stddev_pop(value) AS s FROM tr), b AS (SELECT stddev_pop(value) FILTER (abs(value) < 3 * s) AS s FROM tr, a), c AS (SELECT stddev_pop(value) FILTER (abs(value) < 3 * s) AS s FROM tr, b), e AS (SELECT stddev_pop(value) FILTER (abs(value) < 3 * s) AS s FROM tr, c) SELECT {R.format('s / 0.7235::DOUBLE')} AS sigma FROM e")
def sigma_kclip(s, d):
    return s.createDataFrame([(round(wavelet.sigma_kclip(trace_cells(s, d)), 6),)], "sigma double")
