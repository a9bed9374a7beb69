"""Chart digitising over charts derived from the station-days."""

from pyspark.sql import functions as F

from skygauge.catalog.registry import query
from skygauge.catalog.series_queries import r6
from skygauge.catalog.shapes import CHARTS, PIXELS, PLOTS, SD
from skygauge.charts import axes, digitise, dots, gaps, series
from skygauge.operators import joins as jn
from skygauge.operators import windows as win
from skygauge.sources import adapters as ad

PLOT_END = 2210  # right of the last day of a pixel chart


def blue_mask(spark, d):
    return ad.pixels(spark, d).filter(dots.is_blue())


@query("s16_colour_tests", f"""WITH {PIXELS} SELECT plot_id, count(*) AS blue, count(*) FILTER (WHERE x % 3 < 2) AS near FROM pixels GROUP BY 1""")
def s16(spark, d):
    return ad.pixels(spark, d).groupBy("plot_id").agg(
        F.count_if(dots.is_blue()).alias("blue"), F.count_if(dots.near_rgb(tolerance=1)).alias("near"))


@query("d01_dot_mask", f"""WITH {PIXELS} SELECT plot_id, x + dx AS x, y + dy AS y FROM pixels,
  (SELECT unnest(range(-1, 2)) AS dx) AS a, (SELECT unnest(range(-1, 2)) AS dy) AS b GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def d01(spark, d):
    return dots.dot_mask(ad.pixels(spark, d))


@query("d02_component_dots")
def d02(spark, d):
    return dots.component_dots(dots.dot_mask(ad.pixels(spark, d)))


@query("d02_component_dots_median")
def d02_median(spark, d):
    return dots.component_dots(dots.dot_mask(ad.pixels(spark, d)), split_by="median")


@query("d03_residual_dots")
def d03(spark, d):
    """Older extractor: pixels outside long runs, small areas dropped, no splitting."""
    thin = ad.pixels(spark, d).filter((F.col("x") + F.col("y")) % 2 == 0)  # a chart drawn in thin lines
    return dots.component_dots(dots.residual_mask(thin), min_area=2, split_wide=False)


@query("a29_blue_extent", f"WITH {PIXELS} SELECT plot_id, min(x) AS blue_min_x, max(x) AS blue_max_x FROM pixels GROUP BY 1")
def a29(spark, d):
    return dots.blue_extent(blue_mask(spark, d))


@query("a30_top_border", f"""WITH {PIXELS}, r AS (SELECT plot_id, y, count(*) AS n FROM pixels WHERE x >= 0 AND x < {PLOT_END} AND y >= 10 GROUP BY 1, 2)
SELECT plot_id, min(y) AS top FROM r WHERE n > {PLOT_END} * 0.02 GROUP BY 1""")
def a30(spark, d):
    d = ad.land_charts(spark, d)
    b = ad.plots(spark, d).select("plot_id", F.lit(0).alias("left"), F.lit(PLOT_END).alias("right"))
    return dots.top_border(ad.pixels(spark, d), b, share=0.02)


GRID_ENDS = """o AS (SELECT plot_id, axis, min(pos) AS a, max(pos) AS z FROM grid GROUP BY 1, 2),
l AS (SELECT plot_id, axis, 'first' AS side, a AS pos FROM o UNION ALL SELECT plot_id, axis, 'last', z FROM o)"""


@query("a32_border_spread", f"""WITH {CHARTS}, {GRID_ENDS} SELECT axis, side, min(pos) AS lo, max(pos) AS hi, round(stddev_pop(pos) + 1e-9, 6) AS std FROM l GROUP BY 1, 2""")
def a32_spread(spark, d):
    d = ad.land_charts(spark, d)
    return r6(dots.border_stats(ad.grid_lines(spark, d))[0], "std")


@query("a32_border_counts", f"WITH {CHARTS}, {GRID_ENDS} SELECT axis, side, pos, count(*) AS n FROM l GROUP BY 1, 2, 3")
def a32_counts(spark, d):
    d = ad.land_charts(spark, d)
    return dots.border_stats(ad.grid_lines(spark, d))[1]


def colour_gaps(spark, d):
    b = ad.plots(spark, d).select("plot_id", F.lit(0).alias("start"), F.lit(PLOT_END).alias("stop"))
    return win.presence_gaps(blue_mask(spark, d), "x", b, ["plot_id"])


@query("w15_colour_gaps", f"""WITH {PIXELS}, ax AS (SELECT plot_id, CAST(unnest(range(0, {PLOT_END})) AS INTEGER) AS x FROM plots),
e AS (SELECT ax.plot_id, ax.x, ax.x - row_number() OVER (PARTITION BY ax.plot_id ORDER BY ax.x) AS g
      FROM ax LEFT JOIN (SELECT DISTINCT plot_id, x FROM pixels) AS p ON p.plot_id = ax.plot_id AND p.x = ax.x WHERE p.x IS NULL)
SELECT plot_id, min(x) AS gap_start, max(x) AS gap_end FROM e GROUP BY plot_id, g""")
def w15(spark, d):
    d = ad.land_charts(spark, d)
    return colour_gaps(spark, d)


SPACING = PLOTS + """,
st AS (SELECT plot_id, x, lead(x) OVER (PARTITION BY plot_id ORDER BY x) - x AS dx FROM dots),
ct AS (SELECT plot_id, dx, count(*) AS n, min(x) AS seen FROM st WHERE dx > 0 GROUP BY 1, 2),
bs AS (SELECT plot_id, dx AS base FROM ct QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY n DESC, seen) = 1),
sp AS (SELECT plot_id, row_number() OVER (PARTITION BY plot_id ORDER BY n DESC, CASE WHEN dx = base THEN 0 WHEN dx < base THEN 1 ELSE 2 END) AS rank, dx, n
       FROM ct JOIN bs USING (plot_id) WHERE abs(dx - base) <= 1),
cand AS (SELECT plot_id, min(dx) AS c1, max(dx) AS c2, CAST(arg_min(n, dx) AS DOUBLE) / arg_max(n, dx) AS target FROM sp GROUP BY 1)"""


@query("a28_common_spacings", f"WITH {SPACING} SELECT * FROM sp")
def a28(spark, d):
    return gaps.common_spacings(ad.dots(spark, ad.land_charts(spark, d)))


def candidates(spark, d):
    return gaps.spacing_candidates(gaps.common_spacings(ad.dots(spark, d)))


def plot_bounds(spark, d):
    return ad.plots(spark, d).select("plot_id", "data_start", "data_end")


def tick_seconds(spark, d):
    return ad.ticks(spark, d).withColumn("sec", F.unix_timestamp(F.col("date").cast("timestamp")))


RANGES = SPACING + """,
ends AS (SELECT plot_id, min(x) AS fx, max(x) AS lx FROM dots GROUP BY 1),
rg AS (SELECT plot_id, CAST(data_start - c2 AS DOUBLE) AS x_left, CAST(fx AS DOUBLE) AS x_right FROM ends JOIN plots USING (plot_id) JOIN cand USING (plot_id) WHERE fx > data_start
       UNION ALL SELECT plot_id, x, x + dx FROM st JOIN cand USING (plot_id) WHERE dx > c2 + 1
       UNION ALL SELECT plot_id, lx, data_end + c2 FROM ends JOIN plots USING (plot_id) JOIN cand USING (plot_id) WHERE lx < data_end),
gp AS (SELECT plot_id, CAST(row_number() OVER (PARTITION BY plot_id ORDER BY x_left, x_right) - 1 AS INTEGER) AS gap, x_left, x_right FROM rg)"""


def ranges(spark, d):
    return gaps.missing_ranges(ad.dots(spark, d), plot_bounds(spark, d), tick_seconds(spark, d), candidates(spark, d))


@query("w16_missing_ranges", f"WITH {RANGES} SELECT * FROM gp")
def w16(spark, d):
    d = ad.land_charts(spark, d)
    return ranges(spark, d)


@query("w17_cluster_positions", f"""WITH {PLOTS}, f AS (SELECT plot_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY plot_id ORDER BY x) <= 3 THEN 0 ELSE 1 END AS new FROM dots),
c AS (SELECT plot_id, x, sum(new) OVER (PARTITION BY plot_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM f)
SELECT plot_id, CAST(floor(avg(x)) AS INTEGER) AS x FROM c GROUP BY plot_id, c""")
def w17(spark, d):
    return win.cluster_positions(ad.dots(spark, d), "x", ["plot_id"], max_gap=3)


@query("w18_tick_spacing", f"""WITH {PLOTS}, t AS (SELECT plot_id, x, x - lag(x) OVER w AS dx, date - lag(date) OVER w AS dd FROM ticks WINDOW w AS (PARTITION BY plot_id ORDER BY x))
SELECT plot_id, median(dx) AS dx, median(dd) * 86400.0::DOUBLE AS dt FROM t GROUP BY 1""")
def w18(spark, d):
    return axes.tick_spacing(ad.ticks(spark, d)).select("plot_id", "dx", F.col("dt").cast("double").alias("dt"))


@query("j12_nearest_dot", f"""WITH {PLOTS} SELECT t.plot_id, t.label, CAST(abs(d.x - t.x) AS DOUBLE) AS dist, d.x AS dot_x, d.y AS dot_y
FROM ticks t JOIN dots d ON d.plot_id = t.plot_id AND abs(d.x - t.x) <= 4 QUALIFY row_number() OVER (PARTITION BY t.plot_id, t.label ORDER BY abs(d.x - t.x), d.x) = 1""")
def j12(spark, d):
    d = ad.land_charts(spark, d)
    hit = jn.nearest_within(ad.ticks(spark, d).select("plot_id", "label", "x"), ad.dots(spark, d), "plot_id", "x", F.lit(4.0), "x", ["y"], width=8.0)
    return hit.select("plot_id", "label", F.col("near._d").cast("double").alias("dist"), F.col("near._rx").alias("dot_x"), F.col("near.y").alias("dot_y"))


MM = """SELECT d.plot_id, d.x, d.y, round(least(greatest((600.0::DOUBLE - d.y) / 4, 0), mx) + 1e-9, 6) AS mm
FROM dots d JOIN (SELECT plot_id, max(value) AS mx FROM labels GROUP BY 1) AS m USING (plot_id)"""


@query("j13_bracket_lookup", f"WITH {PLOTS} {MM}")
def j13(spark, d):
    d = ad.land_charts(spark, d)
    return r6(series.pixel_to_mm(ad.dots(spark, d), ad.labels(spark, d), out="mm"), "mm")


@query("d14_pixel_to_mm", f"""WITH {PLOTS}, cut AS (SELECT plot_id, max(value) AS mx FROM labels WHERE value <= 60 GROUP BY 1)
SELECT d.plot_id, d.x, round(least(greatest((600.0::DOUBLE - d.y) / 4, 0), mx) + 1e-9, 6) AS mm FROM dots d JOIN cut USING (plot_id)""")
def d14(spark, d):
    """Only labels up to 60: higher dots are clamped to the outer label."""
    d = ad.land_charts(spark, d)
    low = ad.labels(spark, d).filter("value <= 60")
    return r6(series.pixel_to_mm(ad.dots(spark, d), low, out="mm").select("plot_id", "x", "mm"), "mm")


@query("s15_date_ticks", f"WITH {CHARTS} SELECT plot_id, x, date, label FROM ticks", dates=("date",))
def s15(spark, d):
    return axes.date_ticks(ad.tokens(spark, ad.land_charts(spark, d)))


@query("d04_value_labels", f"""WITH {CHARTS},
num AS (SELECT plot_id, TRY_CAST(text AS DOUBLE) AS v, x + w / 2 AS x, y + h / 2 AS y FROM tokens WHERE regexp_full_match(text, '[0-9]+([.][0-9]+)?')),
ok AS (SELECT * FROM num WHERE (v = 0 OR v >= 10) AND v <= 300 AND y BETWEEN 82 AND 618),
col AS (SELECT * FROM ok QUALIFY abs(x - median(x) OVER (PARTITION BY plot_id)) <= 30),
df AS (SELECT plot_id, v, round(v - lag(v) OVER (PARTITION BY plot_id ORDER BY v) + 1e-9, 3) AS step FROM col),
st AS (SELECT plot_id, step FROM (SELECT plot_id, step, count(*) AS n, min(v) AS first FROM df WHERE step > 1e-6 GROUP BY 1, 2) AS c
       QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY n DESC, first) = 1),
dv AS (SELECT DISTINCT plot_id, v, step, CAST(v AS INTEGER) % CAST(step AS INTEGER) AS res FROM col JOIN st USING (plot_id)),
isl AS (SELECT *, v - step * row_number() OVER (PARTITION BY plot_id, res ORDER BY v) AS g FROM dv),
mn AS (SELECT plot_id, res FROM (SELECT plot_id, res, g, count(*) AS len, min(v) AS first FROM isl GROUP BY 1, 2, 3) AS i
       QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY len DESC, first) = 1),
kept AS (SELECT plot_id, v AS value, arg_max(x, y) AS x, max(y) AS y FROM col JOIN dv USING (plot_id, v) JOIN mn USING (plot_id, res) GROUP BY 1, 2),
e AS (SELECT plot_id, min(value) AS lv, max(value) AS hv, arg_min(y, value) AS ly, arg_max(y, value) AS hy, arg_min(x, value) AS lx, arg_max(x, value) AS hx
      FROM kept GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT *, abs(hy - ly) / (hv - lv) AS ppu FROM e),
extra AS (SELECT plot_id, 0.0::DOUBLE AS value, lx AS x, ly + lv * ppu AS y FROM s WHERE lv <> 0
          UNION ALL SELECT plot_id, hv + (hy - 82) / ppu, hx, 82 FROM s)
SELECT plot_id, round(value + 1e-9, 6) AS value, x, round(y + 1e-9, 6) AS y FROM kept SEMI JOIN s USING (plot_id)
WHERE NOT EXISTS (SELECT 1 FROM extra x WHERE x.plot_id = kept.plot_id AND x.value = kept.value) UNION ALL SELECT plot_id, round(value + 1e-9, 6), x, round(y + 1e-9, 6) FROM extra""")
def d04(spark, d):
    d = ad.land_charts(spark, d)
    return r6(axes.value_labels(ad.tokens(spark, d)), "value", "y")


@query("d05_snap_labels", f"WITH {PLOTS} SELECT plot_id, value, x, y + CAST(value / 20 AS INTEGER) % 2 AS y FROM labels")
def d05_labels(spark, d):
    d = ad.land_charts(spark, d)
    return axes.snap(ad.labels(spark, d), ad.grid_lines(spark, d).filter("axis = 'y'"), "y", "value")


@query("d05_snap_ticks", f"""WITH {PLOTS} SELECT plot_id, x - CASE WHEN month(date) % 3 = 0 THEN 1 ELSE 0 END AS x, date, label FROM ticks""", dates=("date",))
def d05_ticks(spark, d):
    d = ad.land_charts(spark, d)
    return axes.snap(ad.ticks(spark, d), ad.grid_lines(spark, d).filter("axis = 'x'"), "x", "x")


def extent_of_dots(spark, d):
    return dots.blue_extent(ad.dots(spark, d))


def _delta(spark, d):
    return ad.plots(spark, d).select("plot_id", F.lit(3).alias("delta"))


EXT = """x AS (SELECT plot_id, min(dots.x) AS lo, max(dots.x) AS hi FROM dots GROUP BY 1)"""


@query("d06_boundaries", f"""WITH {CHARTS}, {EXT} SELECT plot_id, CASE WHEN lo >= 102 - 3 THEN 102 ELSE 100 + 2 END AS data_start,
  CASE WHEN hi <= data_end THEN data_end ELSE data_end + 6 END AS data_end FROM x JOIN plots USING (plot_id)""")
def d06(spark, d):
    d = ad.land_charts(spark, d)
    return axes.boundaries(extent_of_dots(spark, d), ad.grid_lines(spark, d), ad.ticks(spark, d), _delta(spark, d))


@query("d06_boundaries_older", f"""WITH {CHARTS}, {EXT} SELECT plot_id, CASE WHEN lo >= 102 - 3 THEN 102 ELSE 100 END AS data_start,
  CASE WHEN hi <= data_end + 6 + 3 THEN data_end ELSE hi END AS data_end FROM x JOIN plots USING (plot_id)""")
def d06_older(spark, d):
    d = ad.land_charts(spark, d)
    return axes.older_boundaries(extent_of_dots(spark, d), ad.grid_lines(spark, d), ad.ticks(spark, d), _delta(spark, d))


def mid_ticks(spark, d):
    return ad.ticks(spark, d).filter(F.month("date").between(4, 9))


MID = PLOTS + """,
mt AS (SELECT plot_id, x, CAST(epoch(date) AS BIGINT) AS sec, label FROM ticks WHERE month(date) BETWEEN 4 AND 9),
dd AS (SELECT plot_id, x, sec, x - lag(x) OVER w AS dx, sec - lag(sec) OVER w AS dt FROM mt WINDOW w AS (PARTITION BY plot_id ORDER BY x)),
sp AS (SELECT plot_id, median(dx) AS dx, median(dt) AS dt, min(x) AS fx, max(x) AS lx, min(sec) AS fs, max(sec) AS ls FROM dd GROUP BY 1),
nt AS (SELECT plot_id, fx - k * dx AS x, fs - k * dt AS sec FROM sp JOIN plots USING (plot_id), (SELECT unnest(range(1, 20)) AS k) AS ks WHERE fx - k * dx >= data_start
       UNION ALL SELECT plot_id, lx + k * dx, ls + k * dt FROM sp JOIN plots USING (plot_id), (SELECT unnest(range(1, 20)) AS k) AS ks WHERE lx + k * dx <= data_end),
ext AS (SELECT plot_id, x, CAST(sec AS DOUBLE) AS sec, label FROM mt UNION ALL SELECT plot_id, x, sec, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m') FROM nt)"""


@query("d07_extend_ticks", f"WITH {MID} SELECT * FROM ext")
def d07(spark, d):
    d = ad.land_charts(spark, d)
    return axes.extend_ticks(mid_ticks(spark, d), plot_bounds(spark, d))


@query("d07_missing_left_tick", f"""WITH {MID}, b AS (SELECT plot_id, sec - min(sec) OVER (PARTITION BY plot_id) AS s, min(sec) OVER (PARTITION BY plot_id) AS base, x FROM mt),
f AS (SELECT plot_id, any_value(base) AS base, regr_slope(s, x) AS m, regr_intercept(s, x) AS c FROM b GROUP BY 1),
k AS (SELECT plot_id, base, m, c, fx - dx >= 100 + 0.4 * dx AS fits, CASE WHEN fx - dx >= 100 + 0.4 * dx THEN fx - dx ELSE 100 END AS x FROM f JOIN sp USING (plot_id))
SELECT plot_id, fits AS "exists", CAST(x AS DOUBLE) AS x, CAST(round((base + m * x + c) / 3600) AS BIGINT) AS hour,
  CASE WHEN fits THEN 'estimated_missing_tick' ELSE 'border_fallback' END AS method FROM k""")
def d07_left(spark, d):
    d = ad.land_charts(spark, d)
    out = axes.missing_left_tick(mid_ticks(spark, d), border_x=100)
    hour = F.round(F.unix_micros("timestamp") / 3.6e9).cast("bigint")
    return out.select("plot_id", "exists", "x", hour.alias("hour"), "method")


@query("d08_time_window", f"""WITH {PLOTS}, b AS (SELECT plot_id, epoch(date) - min(epoch(date)) OVER (PARTITION BY plot_id) AS s, min(date) OVER (PARTITION BY plot_id) AS base, x FROM ticks),
f AS (SELECT plot_id, any_value(base) AS base, regr_slope(s, x) AS m, regr_intercept(s, x) AS c FROM b GROUP BY 1),
w AS (SELECT plot_id, base + CAST(floor((m * data_start + c) / 86400 + 1.0::DOUBLE / 3) AS INTEGER) AS a,
             base + CAST(floor((m * data_end + c) / 86400 + 1.0::DOUBLE / 3) AS INTEGER) AS z FROM f JOIN plots USING (plot_id)),
v AS (SELECT plot_id, a, CASE WHEN month(z) = 1 AND day(z) = 1 THEN z - 1 ELSE z END AS z FROM w)
SELECT plot_id, least(a, z) AS t0, greatest(a, z) AS t1, greatest(a, z) - least(a, z) + 1 AS expected_n FROM v""", dates=("t0", "t1"))
def d08(spark, d):
    d = ad.land_charts(spark, d)
    return axes.time_window(tick_seconds(spark, d), plot_bounds(spark, d))


def anchors(spark, d):
    dot = ad.dots(spark, d)
    tol = ad.plots(spark, d).select("plot_id", F.lit(1.0).alias("tol"))
    return series.pick_anchor(series.tick_matches(ad.ticks(spark, d), dot, gaps.common_spacings(dot), tol))


ANCHOR = SPACING + """,
cx AS (SELECT plot_id, dx, row_number() OVER (PARTITION BY plot_id ORDER BY dx) AS i FROM sp),
pr AS (SELECT plot_id, x AS xt, date, label, 0 AS ord, x AS target, 0 AS days FROM ticks
       UNION ALL SELECT t.plot_id, t.x, date, label, 2 * i - 1, t.x - dx, -1 FROM ticks t JOIN cx USING (plot_id)
       UNION ALL SELECT t.plot_id, t.x, date, label, 2 * i, t.x + dx, 1 FROM ticks t JOIN cx USING (plot_id)),
hit AS (SELECT pr.*, d.x AS x, d.y AS y FROM pr JOIN dots d ON d.plot_id = pr.plot_id AND abs(d.x - target) <= 1
        QUALIFY row_number() OVER (PARTITION BY pr.plot_id, label ORDER BY ord, abs(d.x - target), d.x) = 1),
an AS (SELECT plot_id, x, y, date + days AS date FROM hit QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY abs(x - xt), xt) = 1)"""


@query("d09_anchor", f"WITH {ANCHOR} SELECT plot_id, x, y, CAST(date AS DATE) AS date FROM an", dates=("date",))
def d09(spark, d):
    d = ad.land_charts(spark, d)
    return anchors(spark, d)


def shortage(spark, d):
    return ad.plots(spark, d).select("plot_id", (F.col("n_days") - F.col("n_dots")).alias("n_missing"))


OPTIONS = RANGES + """,
ng AS (SELECT plot_id, count(*) AS n_gaps FROM gp GROUP BY 1),
rm AS (SELECT plot_id, n_gaps, CAST(n_days - n_dots - n_gaps AS INTEGER) AS remaining FROM plots JOIN ng USING (plot_id) WHERE n_days - n_dots - n_gaps >= 0),
ex AS (SELECT plot_id, n_gaps, remaining, CAST(unnest(range(0, remaining + 1)) AS INTEGER) AS extra FROM rm),
al AS (SELECT gp.plot_id, gap, n_gaps, remaining, extra, extra + 2 AS m, c1, c2, target, CAST(x_right - x_left AS INTEGER) AS dx, x_left, x_right
       FROM gp JOIN ex USING (plot_id) JOIN cand USING (plot_id)),
op AS (SELECT *, CASE WHEN c1 = c2 THEN 0 ELSE (dx - m * c1) // nullif(c2 - c1, 0) END AS b FROM al
       WHERE (c1 = c2 AND dx = m * c1) OR (c1 < c2 AND dx >= m * c1 AND dx <= m * c2 AND (dx - m * c1) % nullif(c2 - c1, 0) = 0))"""


@query("d10_gap_options", f"""WITH {OPTIONS} SELECT plot_id, gap, n_gaps, remaining, extra, CAST(m - b AS INTEGER) AS a, CAST(b AS INTEGER) AS b,
  round(abs(CASE WHEN b = 0 THEN 1e9 ELSE CAST(m - b AS DOUBLE) / b END - target) + 1e-9, 6) AS cost FROM op""")
def d10(spark, d):
    d = ad.land_charts(spark, d)
    return r6(gaps.gap_options(ranges(spark, d), shortage(spark, d), candidates(spark, d)), "cost")


@query("d11_chosen_options")
def d11(spark, d):
    d = ad.land_charts(spark, d)
    return gaps.choose_options(gaps.gap_options(ranges(spark, d), shortage(spark, d), candidates(spark, d)))


@query("d12_insert_missing", f"""WITH {OPTIONS},
ch AS (SELECT *, m - b AS a, min(gap) OVER (PARTITION BY plot_id) AS g0 FROM op QUALIFY row_number() OVER (PARTITION BY plot_id, gap ORDER BY extra) = 1),
pt AS (SELECT *, unnest(range(1, extra + 2)) AS k FROM ch),
s AS (SELECT pt.*, least(k, a) * c1 + greatest(k - a, 0) * c2 AS sk, least(1, a) * c1 + greatest(1 - a, 0) * c2 AS s1, fx, data_start
      FROM pt JOIN ends USING (plot_id) JOIN plots USING (plot_id))
SELECT plot_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM dots
UNION ALL SELECT plot_id, CASE WHEN gap = 0 AND fx > x_left THEN data_start + sk - s1 ELSE x_left + sk END, NULL FROM s""")
def d12(spark, d):
    """Each gap takes its smallest feasible number of points."""
    d = ad.land_charts(spark, d)
    holes, cand = ranges(spark, d), candidates(spark, d)
    o = gaps.gap_options(holes, shortage(spark, d), cand)
    least = o.groupBy("plot_id", "gap").agg(F.min_by(F.struct("extra", "a", "b", "cost"), "extra").alias("c")).select("plot_id", "gap", "c.*")
    return gaps.insert_missing(ad.dots(spark, d), holes, least, cand, plot_bounds(spark, d))


def chart_days(spark, d):
    """All days of each chart's year, as in the file beside the chart."""
    p = ad.plots(spark, d)
    return p.select("plot_id", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))


@query("d13_map_by_anchor", f"""WITH {ANCHOR},
rk AS (SELECT plot_id, x, y, row_number() OVER (PARTITION BY plot_id ORDER BY x, y) AS i FROM dots),
sh AS (SELECT an.plot_id, dayofyear(an.date) - min(i) AS shift FROM an JOIN rk ON rk.plot_id = an.plot_id AND rk.x = an.x AND rk.y = an.y GROUP BY an.plot_id, an.date),
dy AS (SELECT plot_id, CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM plots)
SELECT dy.plot_id, dy.date, CAST(rk.y AS DOUBLE) AS y FROM dy JOIN sh USING (plot_id) LEFT JOIN rk ON rk.plot_id = dy.plot_id AND rk.i + shift = dayofyear(dy.date)""",
       dates=("date",))
def d13(spark, d):
    d = ad.land_charts(spark, d)
    dot = ad.dots(spark, d)
    out = series.map_by_anchor(dot, anchors(spark, d), chart_days(spark, d))
    return out.withColumn("y", F.col("y").cast("double"))


def chart_frames(spark, d):
    return ad.plots(spark, d).select("plot_id", "data_start", "data_end", "n_days")


def chart_values(spark, d):
    return series.pixel_to_mm(ad.dots(spark, d), ad.labels(spark, d), out="value")


BUCKETS = f"""WITH {PLOTS}, v AS ({MM}),
fr AS (SELECT v.plot_id, x, mm, data_start, n_days, CAST(data_end - data_start AS DOUBLE) AS width FROM v JOIN plots USING (plot_id)),
nx AS (SELECT *, round_even((x - data_start) / width * (n_days - 1), 0) AS day, lead(x) OVER (PARTITION BY plot_id ORDER BY x) AS nxt FROM fr),
hole AS (SELECT DISTINCT plot_id, unnest(range(CAST(day AS BIGINT) + 1, CAST(round_even((nxt - data_start) / width * (n_days - 1), 0) AS BIGINT))) AS day
         FROM nx WHERE nxt - x > 20 * width / n_days),
bk AS (SELECT plot_id, CAST(day AS BIGINT) AS day, coalesce(max(mm) FILTER (WHERE mm > 0.5), 0) AS value, count(*) FILTER (WHERE mm > 0.5) AS wet,
       count(*) FILTER (WHERE mm <= 0.5) AS zero FROM nx WHERE day >= 0 AND day < n_days GROUP BY 1, 2),
sp AS (SELECT plot_id, unnest(range(0, n_days)) AS day FROM plots)"""


@query("d15_dots_to_days", BUCKETS + """ SELECT sp.plot_id, sp.day, CASE WHEN bk.day IS NOT NULL THEN value WHEN hole.day IS NULL THEN 0 END AS value
FROM sp LEFT JOIN bk USING (plot_id, day) LEFT JOIN hole USING (plot_id, day)""")
def d15(spark, d):
    d = ad.land_charts(spark, d)
    return r6(series.dots_to_days(chart_values(spark, d), chart_frames(spark, d))[0], "value")


@query("d15_day_conflicts", BUCKETS + """ SELECT plot_id, count(*) FILTER (WHERE wet >= 2) AS multi_dot_nonzero, count(*) FILTER (WHERE wet = 1 AND zero >= 1) AS mixed_zero_nonzero
FROM bk GROUP BY 1""")
def d15_flags(spark, d):
    d = ad.land_charts(spark, d)
    return series.dots_to_days(chart_values(spark, d), chart_frames(spark, d))[1]


def dot_gaps(spark, d):
    """Pixel ranges without a dot, inclusive and relative to the data start, of at least six pixels."""
    b = ad.plots(spark, d).select("plot_id", F.col("data_start").alias("start"), (F.col("data_end") + 1).alias("stop"))
    g = win.presence_gaps(ad.dots(spark, d), "x", b, ["plot_id"])
    return g.filter("gap_end - gap_start >= 5").select("plot_id", F.col("gap_start").alias("a"), F.col("gap_end").alias("b"))


def absolute_gaps(spark, d):
    return dot_gaps(spark, d).select("plot_id", (F.col("a") + 102).alias("a"), (F.col("b") + 102).alias("b"))


DOT_GAPS = PLOTS + """,
ax AS (SELECT plot_id, CAST(unnest(range(0, data_end + 1 - data_start)) AS INTEGER) AS p FROM plots),
free AS (SELECT ax.plot_id, p, p - row_number() OVER (PARTITION BY ax.plot_id ORDER BY p) AS g
         FROM ax LEFT JOIN (SELECT DISTINCT plot_id, x - 102 AS q FROM dots) AS d ON d.plot_id = ax.plot_id AND q = p WHERE q IS NULL),
dg AS (SELECT plot_id, min(p) AS a, max(p) AS b FROM free GROUP BY plot_id, g HAVING max(p) - min(p) >= 5),
fr AS (SELECT plot_id, n_days, CAST(data_end - data_start AS DOUBLE) / (n_days - 1) AS step FROM plots)"""


@query("d16_allocate_slots")
def d16(spark, d):
    d = ad.land_charts(spark, d)
    return gaps.allocate_slots(dot_gaps(spark, d), shortage(spark, d))


@query("d16_spread_slots")
def d16_spread(spark, d):
    d = ad.land_charts(spark, d)
    return gaps.spread_slots(gaps.allocate_slots(dot_gaps(spark, d), shortage(spark, d)))


@query("d17_points_per_gap", f"""WITH {DOT_GAPS}, n AS (SELECT plot_id, a + 102 AS a, CAST(greatest(round_even((b - a + 1) / 2.7::DOUBLE, 0), 1) AS BIGINT) AS n FROM dg),
k AS (SELECT plot_id, a, unnest(range(0, n)) AS k FROM n)
SELECT plot_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM dots UNION ALL SELECT plot_id, round(a + (k + 0.5) * 2.7::DOUBLE + 1e-9, 6), NULL FROM k""")
def d17_points(spark, d):
    d = ad.land_charts(spark, d)
    return r6(gaps.points_per_gap(ad.dots(spark, d), absolute_gaps(spark, d), 2.7), "x")


@query("d17_one_point_per_gap")
def d17_one(spark, d):
    d = ad.land_charts(spark, d)
    return gaps.one_point_per_gap(ad.dots(spark, d), absolute_gaps(spark, d))


@query("d17_missing_mask", f"""WITH {DOT_GAPS}, g AS (SELECT plot_id, CAST(unnest(range(0, n_days)) AS INTEGER) AS day, step FROM fr),
px AS (SELECT plot_id, day, 102 + day * step AS x FROM g)
SELECT plot_id, day, EXISTS (SELECT 1 FROM dg WHERE dg.plot_id = px.plot_id AND x >= a + 102 AND x <= b + 102) AS missing FROM px""")
def d17_mask(spark, d):
    d = ad.land_charts(spark, d)
    step = (F.col("data_end") - F.col("data_start")) / (F.col("n_days") - 1)
    grid = chart_frames(spark, d).withColumn("day", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1))).select(
        "plot_id", "day", (F.col("data_start") + F.col("day") * step).alias("x"))
    return series.missing_mask(grid, absolute_gaps(spark, d)).select("plot_id", "day", "missing")


@query("d17_nearest_day", f"""WITH {DOT_GAPS}, q AS (SELECT plot_id, x, y, CAST(greatest(0, least(ceil((x - 102) / step - 0.5), n_days - 1)) AS INTEGER) AS day FROM dots JOIN fr USING (plot_id))
SELECT plot_id, day, y FROM q QUALIFY row_number() OVER (PARTITION BY plot_id, day ORDER BY x DESC, y DESC) = 1""")
def d17_nearest(spark, d):
    return series.nearest_day(ad.dots(spark, d), chart_frames(spark, d))


def absent(spark, d):
    g = dot_gaps(spark, d).select("plot_id", F.col("a").alias("gap_start"), F.col("b").alias("gap_end"))
    return series.absent_days(g, chart_frames(spark, d))


@query("d17_absent_days", f"""WITH {DOT_GAPS}, n AS (SELECT plot_id, n_days, CAST(round_even(a / step, 0) AS BIGINT) AS f, CAST(round_even((b - a + 1) / step, 0) AS BIGINT) AS n FROM dg JOIN fr USING (plot_id)),
e AS (SELECT plot_id, n_days, unnest(range(f, f + n)) AS day FROM n)
SELECT DISTINCT plot_id, CAST(day AS INTEGER) AS day FROM e WHERE day >= 0 AND day < n_days""")
def d17_absent(spark, d):
    d = ad.land_charts(spark, d)
    return absent(spark, d)


@query("d17_one_dot_per_day")
def d17_daily(spark, d):
    d = ad.land_charts(spark, d)
    kept, lost = series.one_dot_per_day(ad.dots(spark, d), chart_frames(spark, d), absent(spark, d))
    return kept.withColumn("kept", F.lit(True)).unionByName(lost.drop("x").withColumn("kept", F.lit(False)))


@query("d17_free_days", f"""WITH RECURSIVE {DOT_GAPS}, n AS (SELECT plot_id, n_days, CAST(round_even(a / step, 0) AS BIGINT) AS f, CAST(round_even((b - a + 1) / step, 0) AS BIGINT) AS n FROM dg JOIN fr USING (plot_id)),
e AS (SELECT plot_id, n_days, unnest(range(f, f + n)) AS day FROM n),
gone AS (SELECT plot_id, list(DISTINCT day) AS gone FROM e WHERE day >= 0 AND day < n_days GROUP BY 1),
days AS (SELECT plot_id, list_filter(range(n_days), lambda k: NOT list_contains(coalesce(gone, []), k)) AS free FROM fr LEFT JOIN gone USING (plot_id)),
q AS (SELECT plot_id, x, y, CAST(greatest(0, least(round_even((x - 102) / step, 0), n_days - 1)) AS INTEGER) AS want, row_number() OVER (PARTITION BY plot_id ORDER BY x, y) AS i
      FROM dots JOIN fr USING (plot_id)),
p AS (SELECT q.*, list_min(list_transform(free, lambda k: {{'o': abs(k - want), 'k': k}})).k AS near FROM q JOIN days USING (plot_id)),
walk AS (SELECT plot_id, 0::BIGINT AS i, free, NULL::BIGINT AS day FROM days
  UNION ALL SELECT plot_id, i, list_filter(free, lambda k: k IS DISTINCT FROM day), day FROM (
    SELECT w.plot_id, p.i, w.free, list_min(list_transform(w.free, lambda k: {{'o': abs(k - near), 'k': k}})).k AS day FROM walk w JOIN p ON p.plot_id = w.plot_id AND p.i = w.i + 1))
SELECT plot_id, x, y, want, day FROM walk JOIN p USING (plot_id, i)""")
def d17_free(spark, d):
    d = ad.land_charts(spark, d)
    return series.free_days(ad.dots(spark, d), chart_frames(spark, d), absent(spark, d))


def _digitised(spark, d):
    d = ad.land_charts(spark, d)
    return digitise.digitise(ad.dots(spark, d), ad.ticks(spark, d), ad.labels(spark, d), ad.grid_lines(spark, d), chart_days(spark, d))


@query("d18_digitised_series")
def d18(spark, d):
    return _digitised(spark, d).daily


@query("d18_length_check", f"""WITH {SD}, n AS (SELECT location, year, count(*) AS n_series, dayofyear(make_date(year, 12, 31)) AS n_days FROM sd GROUP BY 1, 2)
SELECT replace(location, ' ', '_') || '-' || year AS plot_id, n_days, n_series FROM n WHERE n_days <> n_series""")
def d18_check(spark, d):
    x = ad.daily(spark, d).select(F.concat_ws("-", F.regexp_replace("location", " ", "_"), F.col("year")).alias("plot_id"), "year")
    days = x.distinct().select("plot_id", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))))
    return series.length_check(x, days)


@query("io16_failed_plots")
def io16(spark, d):
    return _digitised(spark, d).failed


@query("d19_older_value_labels", f"""WITH {CHARTS},
num AS (SELECT plot_id, TRY_CAST(text AS DOUBLE) AS v, x + w / 2 AS x, y + h / 2 AS y FROM tokens WHERE regexp_full_match(text, '[0-9]+') AND x + w <= 100 AND w >= 6 AND h >= 8),
ok AS (SELECT * FROM num WHERE v < 200), low AS (SELECT plot_id, v, arg_max(x, y) AS x, max(y) AS y FROM ok GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY y DESC, v) AS i FROM low),
s AS (SELECT a.plot_id, a.v AS lv, a.y AS ly, a.x AS lx, abs(b.y - a.y) / abs(b.v - a.v) AS ppu FROM rk a JOIN rk b ON a.plot_id = b.plot_id AND a.i = 1 AND b.i = 2),
hi AS (SELECT plot_id, max(v) AS hv, arg_max(y, v) AS hy, arg_max(x, v) AS hx FROM low GROUP BY 1)
SELECT plot_id, round(value + 1e-9, 6) AS value, x, round(y + 1e-9, 6) AS y FROM (
  SELECT plot_id, v AS value, x, y FROM low WHERE v <> 0
  UNION ALL SELECT plot_id, 0, lx, ly + lv * ppu FROM s UNION ALL SELECT plot_id, hv + (hy - 90) / ppu, hx, 90 FROM s JOIN hi USING (plot_id)) AS l""")
def d19(spark, d):
    d = ad.land_charts(spark, d)
    top = ad.plots(spark, d).select("plot_id", F.lit(90).alias("top"))
    return r6(axes.older_value_labels(ad.tokens(spark, d), top, 100), "value", "y")
