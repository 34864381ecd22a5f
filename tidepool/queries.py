"""Queries over the given tables, one or more for each operator, with their SQL where it can express them.

``events`` stands for series and event marks (user: subject, value: score or sample), ``embeddings`` for feature vectors,
``orders``, ``lineitem`` and the dimensions for labels and reference lists.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import columns as C
from tidepool.functions import dsp, features
from tidepool.operators import agg, inference, models, plotdata, select, series, sets, spectral, statespace, timejoin
from tidepool.plans import analyses
from tidepool.plans import recordings as recording_plans
from tidepool.sources import readers, writers
from tidepool.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Events with their time in microseconds, and ``nv``: the value, missing in every seventh row.
EV = "with ev as (select event_id, user_id, event_type, ts, epoch_us(ts) t, value, case when event_id % 7 = 0 then null else value end nv from events)"


def area(to: str, density: str, steps: int = 600) -> str:
    """SQL for the integral of a density (of ``x``) from 0, by Simpson's rule."""
    at = density.replace("x", f"({to}) * i / {steps}e0")
    return f"(({to}) / {3 * steps}e0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: (case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end) * ({at}))))"


def normal_p(z: str) -> str:
    """SQL for the two-sided normal tail."""
    return f"(1 - 2 * {area(f'abs({z})', '0.3989422804014327e0 * power(2.718281828459045e0, -power(x, 2) / 2)')})"


def impulse_response(sos, taps: int) -> str:
    """A causal filter's response as an SQL list."""
    return "[" + ", ".join(f"{v:.17e}" for v in dsp.filter_sections(sos, [1.0] + [0.0] * (taps - 1))[0]) + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    nv = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return e.select("event_id", "user_id", "event_type", "ts", C.micros("ts").alias("t"), "value", nv.alias("nv"))


def r(c, digits: int = 6):
    return F.round(c, digits)


U = ["user_id"]
TE = ["t", "event_id"]


# Sources and sinks ------------------------------------------------------------------------------


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def a1_json_records(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("select event_id, epoch_us(ts) t, value from events where event_id % 7 <> 0")
def a2_timetable(spark, d):
    return events(spark, d).dropna(subset=["nv"]).select("event_id", "t", "value")


@query("select event_id from events where user_id in (select doc_id from labels where quality = 1)")
def a3_reference_list(spark, d):
    keep = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("user_id")).distinct()
    return table(spark, d, "events").join(keep, "user_id", "left_semi").select("event_id")


@query("select user_id, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) click, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) \"view\" from events group by user_id")
def a8_result_matrix(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = writers.result_matrix(e, "user_id", "event_type", ["click", "view"], ["n"])
    return m.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view")])


@query("select vec_id, round(list_dot_product(cast(embedding[1:5] as double[]), [1e0, 2e0, 0.5e0, -1e0, 3e0]), 5) y from embeddings")
def a11_linear_data(spark, d):
    x = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double"))
    made = readers.linear_target(table(spark, d, "embeddings").select("vec_id", x.alias("x")), "x", [1.0, 2.0, 0.5, -1.0, 3.0], 0.0)
    return made.select("vec_id", r("y", 5).alias("y"))


@query("select user_id, [max(value) filter (where event_type = 'click'), max(value) filter (where event_type = 'view')] \"values\" from events group by user_id")
def a12_channels(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return readers.channels_assembled(e, U, "event_type", ["click", "view"], "v")


# Projections and filters ------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem")
def b1_drop_columns(spark, d):
    return select.drop_matching(table(spark, d, "lineitem"), "tax|discount|part|supp|flag|status|date")


@query("select c_custkey, c_nationkey from customer")
def b2_keep_columns(spark, d):
    return select.keep_matching(table(spark, d, "customer"), "key$")


@query("select n_nationkey rightn_nationkey, n_name rightn_name, n_regionkey rightn_regionkey from nation")
def b3_rename(spark, d):
    return select.rename_prefixed(table(spark, d, "nation"), "n_", "right")


@query("select p_partkey, p_size, p_brand, p_retailprice from part")
def b4_features_and_labels(spark, d):
    x, y = select.features_and_labels(table(spark, d, "part"), ["p_retailprice"], ["p_size", "p_brand", "p_size"], "p_partkey")
    return x.join(y, "p_partkey")


@query("select vec_id, list_sum(list_transform(cast(embedding[1:32] as double[]), lambda x: x)) > 0 left_side from embeddings")
def b6_feature_subset(spark, d):
    half = F.slice("embedding", 1, 32)
    total = F.aggregate(half, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (total > 0).alias("left_side"))


@query("select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 1")
def b8_relation(spark, d):
    side = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return select.with_relation(table(spark, d, "orders").join(c, "o_custkey"), side, ["c_nationkey"]).select("o_orderkey", "n_name")


@query(EV + " select event_id, nv from ev where nv is not null")
def b9_labelled(spark, d):
    return events(spark, d).dropna(subset=["nv"]).select("event_id", "nv")


@query(EV + " select event_id from ev where not (coalesce(nv = 0, false) or coalesce(nv > 300, false) or nv is null)")
def b12_exclusion(spark, d):
    e = events(spark, d)
    return select.excluding(e, F.col("nv") == 0, F.col("nv") > 300, F.col("nv").isNull()).select("event_id")


@query("select event_id, value from events where event_type = 'signup'")
def b13_marks(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select("event_id", "value")


@query("select event_id from events where user_id in (select user_id from events group by user_id having count(*) >= 5 and min(value > 100) < max(value > 100))")
def b14_both_classes(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("value") > 100).cast("int"))
    return select.with_both_classes(e, U, "y", 5).select("event_id")


@query(EV + " select event_id from (select *, row_number() over (partition by user_id order by t, event_id) k from ev) where k > 2 and k <= 12")
def b15_head(spark, d):
    return select.head(events(spark, d), U, TE, 10, 2).select("event_id")


@query(EV + " select event_id from (select *, row_number() over (partition by user_id order by t, event_id) k from ev) where k <= case when ts >= timestamp '2024-01-15' then 20 else 30 end")
def b16_capped(spark, d):
    e = events(spark, d)
    n = select.capped_from("ts", "2024-01-15 00:00:00", 30, 20)
    return select.head(e, U, TE, n).select("event_id")


@query(EV + " select event_id from (select *, row_number() over (partition by user_id order by t, event_id) k from ev) where not (user_id % 2 = 0 and k = 3)")
def b17_excluded_ordinals(spark, d):
    e = events(spark, d)
    gone = e.where("user_id % 2 = 0").select("user_id", F.lit(3).cast("long").alias("ordinal")).distinct()
    return select.without_ordinals(e, gone, U, TE).select("event_id")


@query("select p_partkey from part where contains(p_type, 'A')")
def b18_contains(spark, d):
    return table(spark, d, "part").where(F.contains("p_type", F.lit("A"))).select("p_partkey")


@query("select r_regionkey, r_name, case r_name when 'ASIA' then 1 when 'EUROPE' then 2 end \"position\" from region where r_name in ('ASIA', 'EUROPE')")
def b19_order(spark, d):
    order = spark.createDataFrame([("ASIA", 1), ("EUROPE", 2)], "r_name string, position int")
    return select.in_order(table(spark, d, "region"), order, "r_name").select("r_regionkey", "r_name", "position")


@query("select event_id, case when hour(ts) >= 5 and hour(ts) < 14 then 0 when hour(ts) >= 14 then 1 end daypart from events")
def b20_hour_class(spark, d):
    return table(spark, d, "events").select("event_id", C.hour_class("ts").alias("daypart"))


@query("select event_id, case when user_id in (select doc_id from labels where toxic = 1) then null else value end \"value\" from events")
def b21_overwrite(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return select.overwrite_where(table(spark, d, "events"), bad, U, ["value"]).select("event_id", "value")


@query("select event_id from events where value is not null and isfinite(value)")
def b22_finite(spark, d):
    return table(spark, d, "events").where(select.finite("value")).select("event_id")


# Joins in time ----------------------------------------------------------------------------------


@query(EV + " select event_id from ev l where event_type = 'click' and exists (select 1 from ev r where r.event_type = 'signup' and abs(l.t - r.t) <= 120000000)")
def c1_within(spark, d):
    e = events(spark, d)
    return timejoin.within(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "t", 120_000_000).select("event_id")


@query(EV + " select event_id from ev l where event_type = 'click' and not exists (select 1 from ev r where r.user_id = l.user_id and r.event_type = 'signup' and abs(l.t - r.t) <= 3660000000)")
def c2_far(spark, d):
    e = events(spark, d)
    return timejoin.within(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "t", 3_660_000_000, U, "left_anti").select("event_id")


@query(
    EV
    + """, l as (select * from ev where event_type = 'click'), s as (select user_id, t, min(value) v from ev where event_type = 'signup' group by user_id, t),
b as (select event_id, l.t, s.t bt, s.v bv from l asof left join s on l.user_id = s.user_id and l.t >= s.t),
a as (select event_id, s.t at_, s.v av from l asof left join s on l.user_id = s.user_id and l.t <= s.t)
select event_id, case when bt is null or (at_ is not null and at_ - t < t - bt) then at_ else bt end match_t,
case when bt is null or (at_ is not null and at_ - t < t - bt) then av else bv end \"match\" from b join a using (event_id)"""
)
def c3_nearest(spark, d):
    e = events(spark, d)
    return timejoin.nearest(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "t", U, "value").select("event_id", "match_t", "match")


@query(EV + ", n as (select *, row_number() over (partition by user_id order by t, event_id) - 1 i from ev) select m.event_id, round(avg(s.value), 6) \"mean\" from n m join n s on s.user_id = m.user_id and s.i - m.i in (0, 1, 2) where m.event_type = 'signup' group by m.event_id")
def c3_offset_mean(spark, d):
    n = series.numbered(events(spark, d), U, TE)
    marks = n.where("event_type = 'signup'").select("user_id", "event_id", "i")
    return timejoin.mean_at_offsets(marks, n, U, "i", "value", (0, 1, 2), "mean").select("event_id", r("mean").alias("mean"))


@query(
    EV
    + """, l as (select * from ev where event_type = 'view'), s as (select user_id, t, min(value) v from ev where event_type = 'click' group by user_id, t),
a as (select event_id, l.user_id, l.t, s.t mt, s.v from l asof join s on l.user_id = s.user_id and l.t <= s.t),
k as (select *, row_number() over (partition by user_id, mt order by t desc, event_id desc) n from a where mt < t + 7200000000)
select user_id, t, mt match_t, v \"match\" from k where n = 1"""
)
def c4_synced(spark, d):
    e = events(spark, d)
    return timejoin.synced(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "t", 7_200_000_000, U, "value").select("user_id", "t", "match_t", "match")


@query(EV + " select l.event_id, r.t match_t from ev l asof left join (select distinct user_id, t from ev where event_type = 'purchase') r on l.user_id = r.user_id and l.t <= r.t where l.event_type = 'error'")
def c5_forward(spark, d):
    e = events(spark, d)
    return timejoin.forward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "t", U, "value").select("event_id", "match_t")


@query(EV + " select l.event_id, r.t match_t from ev l asof left join (select distinct user_id, t from ev where event_type = 'purchase') r on l.user_id = r.user_id and l.t >= r.t where l.event_type = 'error'")
def c5_backward(spark, d):
    e = events(spark, d)
    return timejoin.backward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "t", U, "value").select("event_id", "match_t")


@query(EV + " select event_id, cast((select count(*) from ev m where m.user_id = l.user_id and m.event_type = 'signup' and m.t <= l.t) as bigint) trial from ev l where event_type = 'click'")
def c6_trials(spark, d):
    e = events(spark, d)
    return timejoin.trials(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "t", U).select("event_id", "trial")


@query("select o_orderkey, cast(count(*) as bigint) n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def c7_aligned(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey"))
    return o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey, b.band from nation, (values ('alpha'), ('beta')) b(band)")
def c8_crossed(spark, d):
    return timejoin.crossed(table(spark, d, "nation").select("n_nationkey"), ["alpha", "beta"], "band")


# Aggregations -----------------------------------------------------------------------------------


@query(EV + " select user_id, round(sum(nv), 4) total, count(nv) n, round(sum(nv * nv), 3) ssq from ev group by user_id")
def d1_skip_sums(spark, d):
    s = agg.skip_sums(events(spark, d), U, "nv")
    return s.select("user_id", r("total", 4).alias("total"), "n", r("ssq", 3).alias("ssq"))


@query(EV + " select user_id, round(sum(nv * (event_id % 3)), 4) total, cast(sum(event_id % 3) filter (where nv is not null) as bigint) n, round(sum(nv * nv * (event_id % 3)), 3) ssq from ev group by user_id")
def d1_weighted_sums(spark, d):
    s = agg.skip_sums(events(spark, d).withColumn("w", F.col("event_id") % 3), U, "nv", "w")
    return s.select("user_id", r("total", 4).alias("total"), "n", r("ssq", 3).alias("ssq"))


@query(EV + " select user_id, round(avg(nv), 6) \"mean\", round(stddev_samp(nv), 6) sd, round(median(nv), 6) med from ev group by user_id")
def d2_moments(spark, d):
    e = events(spark, d)
    moments = e.groupBy("user_id").agg(r(F.avg("nv")).alias("mean"), r(F.stddev_samp("nv")).alias("sd"))
    return agg.joined(moments, agg.percentiles(e, U, "nv", {"med": 0.5}), U).withColumn("med", r("med"))


@query(EV + " select user_id, round(stddev_samp(nv) / sqrt(count(nv)), 6) sem, round(stddev_samp(nv) / sqrt(count(*)), 6) sem_all from ev group by user_id")
def d3_sem(spark, d):
    return events(spark, d).groupBy("user_id").agg(r(agg.sem("nv")).alias("sem"), r(agg.sem("nv", True)).alias("sem_all"))


@query(
    EV.replace("with ev", "with recursive ev")
    + f""", s as (select user_id, count(*) n, stddev_samp(nv) sd from ev group by user_id having count(*) > 1), z as (select distinct n, n - 1e0 v, lgamma(n / 2e0) - lgamma((n - 1) / 2e0) - ln((n - 1) * pi()) / 2 c from s),
b(n, v, c, lo, hi, k) as (select n, v, c, 0e0, 100e0, 0 from z union all select n, v, c, case when inside < 0.475e0 then mid else lo end, case when inside < 0.475e0 then hi else mid end, k + 1
  from (select *, {area('mid', 'power(2.718281828459045e0, c - (v + 1) / 2 * ln(1 + power(x, 2) / v))')} inside from (select *, (lo + hi) / 2 mid from b where k < 50)))
select user_id, n, round(lo * sd / sqrt(n), 6) half_width from s join b using (n) where k = 50"""
)
def d4_t_interval(spark, d):
    s = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("nv").alias("sd")).where("n > 1")
    q = inference.t_quantiles(0.975)(F.col("n") - 1)
    return s.select("user_id", "n", r(q * F.col("sd") / F.sqrt("n")).alias("half_width"))


@query(EV + " select event_id, round((nv - avg(nv) over w) / stddev_samp(nv) over w, 6) z from ev window w as (partition by user_id)")
def d5_z_scores(spark, d):
    return agg.z_scores(events(spark, d), U, "nv", "z").select("event_id", r("z").alias("z"))


@query("select e.event_id, round((e.value - f.m) / case when f.s = 0 then 1 else f.s end, 6) z from events e join (select event_type, avg(value) m, stddev_pop(value) s from events where user_id % 2 = 0 group by event_type) f using (event_type) where user_id % 2 = 1")
def d6_scaler(spark, d):
    e = table(spark, d, "events")
    fitted = agg.scaler(e.where("user_id % 2 = 0"), ["event_type"], "value")
    return agg.scaled(e.where("user_id % 2 = 1"), fitted, ["event_type"], "value", "z").select("event_id", r("z").alias("z"))


@query("select event_id, round(value / sqrt(sum(value * value) over (partition by event_type)), 9) x from events")
def d7_l2(spark, d):
    return agg.l2_normalised(table(spark, d, "events"), ["event_type"], "value", "x").select("event_id", r("x", 9).alias("x"))


@query(EV + " select event_id, cast(nv >= median(nv) over (partition by user_id) as integer) y from ev")
def d9_median_split(spark, d):
    return agg.median_split(events(spark, d), U, "nv", "y").select("event_id", "y")


@query(EV + " select event_id, cast(nv > median(nv) over (partition by user_id) as integer) y from ev")
def d10_median_above(spark, d):
    return agg.median_split(events(spark, d), U, "nv", "y", strict=True).select("event_id", "y")


@query("select event_id, cast(value > 50 as integer) y from events")
def d11_binarise(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") > 50).cast("int").alias("y"))


@query("select event_type, bin, (bin + 0.5e0) * 25e0 center, n, round(n / sum(n) over (partition by event_type), 9) share from (select event_type, cast(least(floor(value / 25), 19) as integer) bin, count(*) n from events where value >= 0 and value <= 500 group by 1, 2)")
def d12_histogram(spark, d):
    h = agg.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0, 20)
    return h.select("event_type", "bin", r("center").alias("center"), "n", r("share", 9).alias("share"))


@query(
    """with s as (select user_id, list(value order by value) s, count(*) n, count(distinct value) d from events group by 1),
q as (select *, greatest(1e0, least(n * 0.25e0 + 0.5e0, n)) a, greatest(1e0, least(n * 0.75e0 + 0.5e0, n)) b from s),
v as (select *, s[cast(floor(a) as int)] x0, coalesce(s[cast(floor(a) as int) + 1], s[cast(floor(a) as int)]) x1, s[cast(floor(b) as int)] y0, coalesce(s[cast(floor(b) as int) + 1], s[cast(floor(b) as int)]) y1 from q),
w as (select *, 2 * (y0 + (y1 - y0) * (b - floor(b)) - x0 - (x1 - x0) * (a - floor(a))) / power(n, 1e0 / 3) w from v)
select user_id, n, d \"distinct\", d < n / 3 \"discrete\", cast(case when n < 20 then ceil(n / 4) when w > 0 then round((list_max(s) - list_min(s)) / w) else 1 end as bigint) bins from w"""
)
def d13_auto_bins(spark, d):
    return agg.auto_bins(table(spark, d, "events"), U, "value")


@query()
def d14_smooth_histogram(spark, d):
    return agg.smooth_histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0)


@query()
def d14_spline(spark, d):
    return agg.spline_density(table(spark, d, "events"), ["event_type"], "value")


@query("select event_type, x, round(avg(exp(-power((x - value) / 20e0, 2) / 2)) / (20e0 * 2.5066282746310002e0), 9) density from events, (select unnest([0e0, 50e0, 100e0, 200e0]) x) group by event_type, x")
def d15_kernel_density(spark, d):
    k = agg.kernel_density(table(spark, d, "events"), ["event_type"], "value", [0, 50, 100, 200], 20.0)
    return k.select("event_type", "x", r("density", 9).alias("density"))


@query(EV + " select user_id, event_type, count(*) n, cast(dense_rank() over (partition by user_id order by event_type) as integer) \"rank\" from ev group by user_id, event_type")
def d16_entries(spark, d):
    return agg.entries(events(spark, d), U, "event_type")


@query(
    EV
    + """, x as (select user_id, nv, event_id % 3 + 1 w from ev where nv is not null), m as (select *, sum(w * nv) over (partition by user_id) / sum(w) over (partition by user_id) mu from x)
select user_id, round(max(mu), 6) \"mean\", round(sqrt(sum(w * power(nv - mu, 2)) / sum(w) / (count(*) - 1)), 6) std_of_mean, round(sqrt(sum(w * power(nv - mu, 2)) / sum(w) * count(*) / (count(*) - 1)), 6) std_of_sample from m group by user_id"""
)
def d17_weighted(spark, d):
    w = agg.weighted_stats(events(spark, d).withColumn("w", F.col("event_id") % 3 + 1), U, "nv", "w")
    return w.select("user_id", *[r(c).alias(c) for c in ("mean", "std_of_mean", "std_of_sample")])


@query("with c as (select event_type, floor(value) v, count(*) n from events group by 1, 2), k as (select *, sum(n) over (partition by event_type order by v) s, sum(n) over (partition by event_type) t from c) select event_type, cast(min(v) as bigint) weighted_median from k where s * 2 >= t group by event_type")
def d18_weighted_median(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.floor("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return agg.weighted_median(c, ["event_type"], "v", "n")


@query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 9) rho from lineitem group by l_returnflag")
def d19_correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.corr("l_quantity", "l_extendedprice"), 9).alias("rho"))


@query("select l_returnflag, round(1 - sum(power(l_extendedprice - 1000 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) r2, round(sqrt(avg(power(l_extendedprice - 1000 * l_quantity, 2))), 4) rmse, round(corr(l_extendedprice, l_quantity), 9) r from lineitem group by l_returnflag")
def d20_fit_quality(spark, d):
    f = agg.fit_quality(table(spark, d, "lineitem").withColumn("g", F.col("l_quantity") * 1000), ["l_returnflag"], "l_extendedprice", "g")
    return f.select("l_returnflag", r("r2").alias("r2"), r("rmse", 4).alias("rmse"), r("r", 9).alias("r"))


LABELLED = "with s as (select user_id, case when event_type in ('click', 'view') then 1 else 0 end y, floor(value / 5) / 100e0 s from events)"


def labelled(spark, d):
    y = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0)
    return table(spark, d, "events").select("user_id", y.alias("y"), (F.floor(F.col("value") / 5) / F.lit(100.0)).alias("s"))


@query(
    LABELLED
    + """, c as (select user_id, count(*) filter (where s >= 0.1e0 and y = 1) tp, count(*) filter (where s >= 0.1e0 and y = 0) fp, count(*) filter (where s < 0.1e0 and y = 0) tn, count(*) filter (where s < 0.1e0 and y = 1) fn from s group by user_id)
select user_id, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 6) sensitivity, round(tn / nullif(tn + fp, 0), 6) specificity, round(tp / nullif(tp + fp, 0), 6) ppv, round(fp / nullif(tn + fp, 0), 6) fpr, round((tp + tn) / (tp + fp + tn + fn), 6) accuracy from c"""
)
def d21_confusion(spark, d):
    c = agg.confusion(labelled(spark, d), U, "y", "s", 0.1)
    return c.select("user_id", "tp", "fp", "tn", "fn", *[r(x).alias(x) for x in ("sensitivity", "specificity", "ppv", "fpr", "accuracy")])


@query(LABELLED + " select user_id, round((avg(s) filter (where y = 1) - avg(s) filter (where y = 0)) / sqrt((var_samp(s) filter (where y = 1) + var_samp(s) filter (where y = 0)) / 2), 6) cohen_d from s group by user_id")
def d23_cohen_d(spark, d):
    return agg.cohen_d(labelled(spark, d), U, "s", "y").select("user_id", r("cohen_d").alias("cohen_d"))


@query(
    """with c as (select l_returnflag a, l_linestatus b, count(*) o from lineitem group by 1, 2), r as (select a, sum(o) r from c group by a), k as (select b, sum(o) k from c group by b), t as (select sum(o) t from c)
select round(sum(power(coalesce(o, 0) - r * k / t, 2) / (r * k / t)), 4) chi2, cast((count(distinct a) - 1) * (count(distinct b) - 1) as bigint) dof from r cross join k cross join t left join c using (a, b)"""
)
def d24_chi_square(spark, d):
    return agg.chi_square(table(spark, d, "lineitem"), [], "l_returnflag", "l_linestatus").select(r("chi2", 4).alias("chi2"), "dof")


@query("with q as (select event_type, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events group by event_type) select event_id from events join q using (event_type) where value >= a - 1 * (b - a) and value <= b + 1 * (b - a)")
def d25_within_iqr(spark, d):
    return agg.within_iqr(table(spark, d, "events"), ["event_type"], "value", 1.0).select("event_id")


@query("with v as (select event_type, var_samp(value) v from events group by event_type) select user_id, date_trunc('day', ts) \"day\" from events join v using (event_type) group by 1, 2 having bool_or(abs(value) > v * 0.08)")
def d26_noisy(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return agg.noisy_samples(e, ["event_type"], ["user_id", "day"], "value", 0.08)


@query("select event_id, round(value / max(value) over (partition by user_id), 9) x from events")
def d27_max_normalised(spark, d):
    return agg.max_normalised(table(spark, d, "events"), U, "value", "x").select("event_id", r("x", 9).alias("x"))


@query("select label, i, round(avg(abs(cast(embedding[i] as double))), 6) c from embeddings, (select unnest(range(1, 65)) i) group by label, i")
def d28_mean_abs(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return e.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(r(F.avg(F.abs(F.col("x").cast("double")))).alias("c"))


@query("select event_id, round(2 * (value - min(value) over w) / (max(value) over w - min(value) over w) - 1, 6) x from events window w as (partition by event_type)")
def d29_min_max(spark, d):
    return agg.min_max_scaled(table(spark, d, "events"), ["event_type"], "value", "x").select("event_id", r("x").alias("x"))


@query(EV + " select event_type, hour(ts) h, round(avg(nv), 6) \"mean\", round(stddev_samp(nv) / sqrt(count(nv)), 6) sem, count(nv) n from ev group by 1, 2")
def d30_curves(spark, d):
    e = events(spark, d).withColumn("h", F.hour("ts").cast("long"))
    return agg.curves(e, ["event_type", "h"], "nv").select("event_type", "h", r("mean").alias("mean"), r("sem").alias("sem"), "n")


@query(EV + " select event_type, hour(ts) h, round(avg(nv), 6) \"mean\", round(stddev_samp(nv) / sqrt(count(nv)), 6) sem, round(median(nv), 6) middle from ev group by 1, 2")
def n_handles(spark, d):
    import numpy as np

    handles = {"mean": np.mean, "sem": lambda v: v.std(ddof=1) / np.sqrt(len(v)) if len(v) > 1 else np.nan, "middle": np.median}
    c = agg.curves_by(events(spark, d).withColumn("h", F.hour("ts").cast("long")), ["event_type", "h"], "nv", handles)
    return c.select("event_type", "h", *[r(n).alias(n) for n in handles])


@query("select event_type, round(avg(m), 6) \"mean\", round(stddev_samp(m), 6) sd from (select event_type, user_id, avg(value) m from events group by 1, 2) group by event_type")
def d31_summary(spark, d):
    m = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return m.groupBy("event_type").agg(r(F.avg("m")).alias("mean"), r(F.stddev_samp("m")).alias("sd"))


@query("select event_type, round(quantile_cont(value, 0.01), 6) low, round(quantile_cont(value, 0.99), 6) high from events group by event_type")
def d32_color_limits(spark, d):
    p = agg.percentiles(table(spark, d, "events"), ["event_type"], "value", {"low": 0.01, "high": 0.99})
    return p.select("event_type", r("low").alias("low"), r("high").alias("high"))


@query(LABELLED + ", k as (select *, rank() over (partition by user_id order by s) + (count(*) over (partition by user_id, s) - 1) / 2e0 r from s) select user_id, round((sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2e0) / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0), 9) auc from k group by user_id")
def d33_auc(spark, d):
    return agg.auc(labelled(spark, d), U, "y", "s").select("user_id", r("auc", 9).alias("auc"))


ROC = LABELLED + ", c as (select user_id, s, sum(y) p, sum(1 - y) n from s group by 1, 2), t as (select user_id, sum(p) tp, sum(n) tn from c group by 1 having sum(p) > 0 and sum(n) > 0), k as (select user_id, s score, sum(p) over w / tp tpr, sum(n) over w / tn fpr from c join t using (user_id) window w as (partition by user_id order by s desc))"


@query(ROC + " select user_id, score, round(tpr, 9) tpr, round(fpr, 9) fpr from k")
def d34_roc(spark, d):
    return agg.roc(labelled(spark, d), U, "y", "s").select("user_id", "score", r("tpr", 9).alias("tpr"), r("fpr", 9).alias("fpr"))


@query(ROC + ", b as (select *, row_number() over (partition by user_id order by round(tpr - fpr, 12) desc, score desc) q from k) select user_id, score \"threshold\", round(tpr - fpr, 9) j from b where q = 1")
def d34_youden(spark, d):
    return agg.youden(labelled(spark, d), U, "y", "s").select("user_id", "threshold", r("j", 9).alias("j"))


# Ordered series ---------------------------------------------------------------------------------


@query(EV + ", x as (select event_id, lead(value) over (partition by user_id order by t, event_id) - value diff from ev) select event_id, round(diff, 6) diff, cast(diff > 0 as integer) \"label\" from x where diff is not null")
def e1_difference(spark, d):
    return series.next_difference(events(spark, d), U, TE, "value", "increased").select("event_id", r("diff").alias("diff"), "label")


@query(EV + ", x as (select *, row_number() over w k, first_value(nv) over w f from ev where nv is not null window w as (partition by user_id order by t, event_id)) select event_id, round((sum(nv) over (partition by user_id order by t, event_id rows 4 preceding) + greatest(5 - k, 0) * f) / 5, 6) smooth from x")
def e2_smoothed(spark, d):
    return series.smoothed(events(spark, d), U, TE, "nv", 5, "smooth").select("event_id", r("smooth").alias("smooth"))


def _middle(h0: str, d0: str, h1: str, d1: str) -> str:
    w0, w1 = f"(2 * {h1} + {h0})", f"({h1} + 2 * {h0})"
    return f"case when {d0} * {d1} <= 0 then 0 else ({w0} + {w1}) / ({w0} / {d0} + {w1} / {d1}) end"


def _end(h0: str, d0: str, h1: str, d1: str) -> str:
    s = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"case when {d1} is null then {d0} when {s} * {d0} <= 0 then 0 when {d0} * {d1} <= 0 and abs({s}) > 3 * abs({d0}) then 3 * {d0} else {s} end"


@query(
    EV
    + f""", y as (select user_id, t x, avg(nv) y from ev where nv is not null group by 1, 2),
n as (select *, lag(x) over w xm, lag(y) over w ym, lead(x) over w x1, lead(y) over w y1, lead(x, 2) over w x2, lead(y, 2) over w y2, min(x) over (partition by user_id) o from y window w as (partition by user_id order by x)),
d as (select *, (x1 - x) * 1e0 h, (y1 - y) / (x1 - x) d, (x - xm) * 1e0 h0, (y - ym) / (x - xm) d0, (x2 - x1) * 1e0 h2, (y2 - y1) / (x2 - x1) d2 from n where x1 is not null),
m as (select *, case when xm is null then {_end('h', 'd', 'h2', 'd2')} else {_middle('h0', 'd0', 'h', 'd')} end m0, case when x2 is null then {_end('h', 'd', 'h0', 'd0')} else {_middle('h', 'd', 'h2', 'd2')} end m1 from d),
k as (select *, unnest(range(cast(ceil((x - o) / 86400e6) as bigint), cast(ceil((x1 - o) / 86400e6) as bigint) + case when x2 is null and (x1 - o) % 86400000000 = 0 then 1 else 0 end)) k from m),
s as (select *, o + k * 86400000000 at_, (o + k * 86400000000 - x) / h s from k)
select user_id, at_ t, round((1 + 2 * s) * (1 - s) * (1 - s) * y + s * (1 - s) * (1 - s) * h * m0 + s * s * (3 - 2 * s) * y1 + s * s * (s - 1) * h * m1, 6) "value" from s"""
)
def e3_resampled(spark, d):
    return series.resampled(events(spark, d), U, "t", "nv", 86_400_000_000).withColumn("value", r("value"))


@query(
    EV
    + """, m as (select user_id, event_id, t, nv - avg(nv) over (partition by user_id) x, count(*) over (partition by user_id) n from ev), k as (select *, row_number() over (partition by user_id order by event_id) i from m)
select a.user_id, l.lag, round(sum(a.x * b.x) / max(a.n), 4) acov from k a join (select unnest(range(0, 6)) lag) l on true join k b on b.user_id = a.user_id and b.i = a.i + l.lag group by 1, 2"""
)
def e4_autocovariance(spark, d):
    a = series.autocovariance(events(spark, d), U, "event_id", "nv", 5)
    return a.select("user_id", F.col("lag").cast("long").alias("lag"), r("acov", 4).alias("acov"))


@query(
    EV
    + """, m as (select user_id, event_id, t, nv - avg(nv) over (partition by user_id) x, count(*) over (partition by user_id) n from ev), k as (select *, row_number() over (partition by user_id order by event_id) i from m)
select a.user_id, l.lag, round(sum(a.x * b.x) / max(a.n), 4) acov from k a join (select unnest(range(0, 6)) lag) l on true join k b on b.user_id = a.user_id and b.i = a.i + l.lag group by 1, 2"""
)
def e4_by_blocks(spark, d):
    a = series.autocovariance_by_blocks(events(spark, d), U, "event_id", "nv", 5)
    return a.select("user_id", F.col("lag").cast("long").alias("lag"), r("acov", 4).alias("acov"))


def _levinson(group: str, lags: int, scale: str) -> str:
    """SQL of the recursion over the autocovariances of ``value``, in order of event_id."""
    return f"""with recursive x as (select {group} g, event_id, value - avg(value) over (partition by {group}) x, count(*) over (partition by {group}) n, row_number() over (partition by {group} order by event_id) i from events),
v as (select a.g, l.lag, sum(a.x * b.x) / max({scale}) v, max(a.n) n from x a join (select unnest(range(0, {lags + 1})) lag) l on true join x b on b.g = a.g and b.i = a.i + l.lag group by 1, 2),
c as (select g, max(n) n, list(v order by lag) c from v group by g),
k(g, n, c, a, e, k, r) as (select g, n, c, cast([] as double[]), c[1], 0, 0e0 from c union all
  select g, n, c, list_append(list_transform(range(1, k + 1), lambda j: a[j] - q * a[k + 1 - j]), q), e * (1 - q * q), k + 1, q
  from (select *, case when e > 0 then (c[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: a[j] * c[k + 2 - j])), 0)) / e else 0 end q from k where k < len(c) - 1))
select g {group}, cast(k as integer) lag, round(r, 6) pacf, abs(r) > 1.959963984540054e0 / sqrt(greatest(n - 1 - k, 1)) significant from k where k > 0"""


@query(_levinson("user_id", 8, "1"))
def e6_pacf(spark, d):
    a = series.autocovariance(events(spark, d), U, "event_id", "value", 8, "coeff")
    return series.partial_autocorrelation(a, U).withColumn("pacf", r("pacf"))


@query(
    """with d as (select user_id, ts, event_id, cast(value as decimal(18, 6)) v from events), e as (select *, count(v) over w k, sum(v) over w s from d window w as (partition by user_id)), b as (select *, v * k > s up, row_number() over (partition by user_id order by ts, event_id) i, count(*) over (partition by user_id) n from e),
c as (select *, coalesce(lag(up) over (partition by user_id order by i), false) pu from b), g as (select *, sum(case when up and not pu then 1 else 0 end) over (partition by user_id order by i) run from c),
s as (select user_id, run, max(n) n, max(i) - min(i) + 1 - max(case when i = n then 1 else 0 end) len from g where up group by user_id, run)
select u.user_id, u.n n_rows, cast(coalesce(x.k, 0) as bigint) bouts, round(md, 6) mean_duration, round(coalesce(tt, 0), 6) total_time, round(100e0 * coalesce(tt, 0) / u.n, 6) percent
from (select user_id, count(*) n from events group by user_id) u left join (select user_id, count(*) k, avg(len) md, cast(sum(len) as double) tt from s group by user_id) x using (user_id)"""
)
def e7_bouts(spark, d):
    """Values are taken to six decimals, of which sums are exact."""
    b = series.bouts(events(spark, d).withColumn("value", F.col("value").cast("decimal(18,6)")), U, TE, "value")
    return b.select("user_id", "n_rows", "bouts", *[r(c).alias(c) for c in ("mean_duration", "total_time", "percent")])


@query("select vec_id, w \"window\", w * 8 \"start\", round(list_sum(cast(embedding[w * 8 + 1 : w * 8 + 16] as double[])), 5) total from embeddings, (select cast(unnest(range(0, 7)) as integer) w)")
def e8_sliding(spark, d):
    w = series.sliding(table(spark, d, "embeddings"), ["vec_id"], "embedding", 16, 8)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return w.select("vec_id", "window", "start", r(total, 5).alias("total"))


@query("select vec_id, w \"window\", w * 8 \"start\", round(list_sum(cast(embedding[w * 8 + 1 : w * 8 + 16] as double[])), 5) total from embeddings, (select cast(unnest(range(0, 7)) as integer) w)")
def n_sliding_rows(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    w = series.sliding_rows(rows, "vec_id", "i", "v", 16, 8)
    return w.select("vec_id", "window", "start", r(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(EV + ", n as (select *, row_number() over (partition by user_id order by t, event_id) - 1 i from ev) select user_id, cast(floor(i / 5) as bigint) \"window\", round(avg(value), 6) m from n group by 1, 2 having count(*) = 5")
def e9_tumbling(spark, d):
    n = series.numbered(events(spark, d), U, TE)
    return series.tumbling(n, U, "i", 5, r(F.avg("value")).alias("m"))


@query(EV + ", n as (select user_id, event_id, row_number() over (partition by user_id order by t, event_id) - 1 i from ev) select user_id, event_id, round((i + 0.5) / 420.1, 9) mid from n")
def e10_midpoints(spark, d):
    n = series.numbered(events(spark, d), U, TE)
    return n.select("user_id", "event_id", r((F.col("i") + 0.5) / 420.1, 9).alias("mid"))


@query(EV + ", x as (select *, row_number() over w i, coalesce(abs(value - lag(value) over w) > 20, true) moved from ev window w as (partition by user_id order by t, event_id)), l as (select user_id, max(i) last from x where moved group by 1) select event_id from x join l using (user_id) where i <= last")
def e12_constant_tail(spark, d):
    return series.without_constant_tail(events(spark, d), U, TE, ["value"], 20.0).select("event_id")


@query(EV + ", g as (select user_id, case when count(*) > 1 then round((max(t) - min(t)) / (count(*) - 1) / 3.6e9, 1) end gap from ev group by user_id) select user_id, gap, cast(case when gap > 0 then floor(72 / gap) end as bigint) lags from g")
def e13_gap_hours(spark, d):
    return series.mean_gap_hours(events(spark, d), U, "t")


@query(EV + ", n as (select user_id, row_number() over (partition by user_id order by t, event_id) - 1 i, count(*) over (partition by user_id) n from ev) select user_id, i fold, greatest(i - 4, 0) \"first\", least(i + 4, n - 1) \"last\", n - (least(i + 4, n - 1) - greatest(i - 4, 0) + 1) n_train from n")
def e14_leave_one_out(spark, d):
    return series.leave_one_out(series.numbered(events(spark, d), U, TE), U, "i", 4)


@query(EV + " select event_id, cast(ntile(4) over (partition by user_id order by t, event_id) as integer) fold from ev")
def e15_folds(spark, d):
    return series.k_folds(events(spark, d), U, TE, 4).select("event_id", "fold")


@query(EV + ", n as (select user_id, row_number() over (partition by user_id order by t, event_id) - 1 i, ntile(4) over (partition by user_id order by t, event_id) f from ev), r as (select user_id, f, min(i) a, max(i) b from n group by 1, 2) select n.user_id, cast(r.f as integer) test_fold, count(*) n from n join r using (user_id) where i <= a - 3 or i >= b + 3 group by 1, 2")
def e16_far_from_test(spark, d):
    n = series.k_folds(series.numbered(events(spark, d), U, TE), U, TE, 4)
    return series.far_from_test(n, U, "i", "fold", 3).groupBy("user_id", "test_fold").agg(F.count(F.lit(1)).alias("n"))


@query(EV + ", n as (select event_id, row_number() over (partition by user_id order by t, event_id) - 1 i, count(*) over (partition by user_id) n from ev) select event_id, i >= n - ceil(n * 0.3e0) is_test from n")
def e17_split(spark, d):
    return series.chronological_split(events(spark, d), U, TE).select("event_id", "is_test")


@query(LABELLED + " select user_id, s, max(r) \"rank\" from (select user_id, s, rank() over (partition by user_id order by s) + (count(*) over (partition by user_id, s) - 1) / 2e0 r from s) group by 1, 2")
def e18_mid_ranks(spark, d):
    return series.mid_ranks(labelled(spark, d), U, "s").select("user_id", "s", "rank").distinct()


@query("select user_id, arg_max(event_id, struct_pack(a := value, b := -event_id)) best, arg_min(event_id, struct_pack(a := value, b := event_id)) worst from events group by user_id")
def e19_arg_max(spark, d):
    e = table(spark, d, "events")
    best, worst = F.max_by("event_id", F.struct("value", -F.col("event_id"))), F.min_by("event_id", F.struct("value", "event_id"))
    return e.groupBy("user_id").agg(best.alias("best"), worst.alias("worst"))


# Sets and shapes --------------------------------------------------------------------------------


@query("select event_id, cast(row_number() over (partition by user_id order by value, event_id) as integer) \"rank\" from events")
def s1_order(spark, d):
    return sets.order_ranks(table(spark, d, "events"), U, ["value", "event_id"]).select("event_id", "rank")


@query("select user_id, event_id, cast(k as integer) \"rank\" from (select *, row_number() over (partition by user_id order by value desc, event_id) k from events) where k <= 5")
def s3_top(spark, d):
    return sets.top(table(spark, d, "events"), U, [F.desc("value"), "event_id"], 5).select("user_id", "event_id", "rank")


@query("select c_custkey id, c_nationkey nation, null brand from customer union all by name select p_partkey id, null nation, p_brand brand from part")
def s4_stacked(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return sets.stacked([a, b])


@query("select c_custkey from customer except select o_custkey from orders")
def s5_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("select p_partkey from part where p_size in (1, 7, 15)")
def s6_members(spark, d):
    return table(spark, d, "part").where(F.col("p_size").isin(1, 7, 15)).select("p_partkey")


@query("select l_orderkey, l_linenumber, 'l_quantity' \"name\", l_quantity \"value\" from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def s7_melted(spark, d):
    return sets.melted(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("select user_id, round(avg(value) filter (where event_type = 'click'), 6) click, round(avg(value) filter (where event_type = 'view'), 6) \"view\" from events group by user_id")
def s8_pivoted(spark, d):
    return sets.pivoted(table(spark, d, "events"), U, "event_type", ["click", "view"], r(F.avg("value")))


@query("select 'n' \"name\", cast(count(*) filter (where l_returnflag = 'A') as double) A, cast(count(*) filter (where l_returnflag = 'N') as double) N from lineitem union all select 'q', sum(l_quantity) filter (where l_returnflag = 'A'), sum(l_quantity) filter (where l_returnflag = 'N') from lineitem")
def s9_transposed(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return sets.transposed(m, "l_returnflag", ["n", "q"], ["A", "N"])


@query("select n_nationkey, cast(unnest(range(1, n_regionkey + 1)) as integer) \"copy\" from nation")
def s10_repeated(spark, d):
    return sets.repeated(table(spark, d, "nation"), "n_regionkey").select("n_nationkey", "copy")


# Scalar functions -------------------------------------------------------------------------------


@query("with x as (select event_id, cast(floor(value) as double) v, floor(value / 10) / 100e0 q from events) select event_id, printf('%.2f (p=%.2f%s)', v, q, case when q < 0.05e0 then '***' else '' end) txt, v \"value\", q p from x")
def g_result_text(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor("value").cast("double").alias("v"), (F.floor(F.col("value") / 10) / F.lit(100.0)).alias("q"))
    t = e.select("event_id", C.result_text("v", "q").alias("txt"))
    return t.select("event_id", "txt", *C.parse_result("txt"))


@query("select event_id, cast(user_id % 4 as integer) contact_1, cast(event_id % 4 as integer) contact_2 from events")
def g_contacts(spark, d):
    e = table(spark, d, "events").withColumn("c", F.concat(F.lit("E"), F.col("user_id") % 4, F.lit("E"), F.col("event_id") % 4))
    return e.select("event_id", *C.contact_pair("c"))


@query("select event_id, round(10 * log10(value + 2.220446049250313e-16), 6) db, power(2e0, ceil(log2(value))) p2, round(1 / (1 + exp(-value / 100)), 9) s from events")
def g_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r(C.decibel(v)).alias("db"), C.next_power_of_two(v).alias("p2"), r(C.sigmoid(v / 100), 9).alias("s"))


# Inference --------------------------------------------------------------------------------------


@query("with n as (select event_type, value from events where user_id % 2 = 0), o as (select event_type, max(value) / 2 v from events where user_id % 2 = 1 group by 1) select o.event_type, round((count(*) filter (where n.value > o.v) + 1) / (count(*) + 1), 9) p from o join n using (event_type) group by 1")
def k4_permutation_p(spark, d):
    e = table(spark, d, "events")
    o = e.where("user_id % 2 = 1").groupBy("event_type").agg((F.max("value") / 2).alias("value"))
    return inference.permutation_p(e.where("user_id % 2 = 0"), o, ["event_type"], "value").select("event_type", r("p", 9).alias("p"))


PV = "with p as (select user_id, event_id, round(1 / (1 + value), 6) p from events), k as (select *, row_number() over (partition by user_id order by p) i, count(*) over (partition by user_id) v from p)"


def p_values(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.round(1 / (1 + F.col("value")), 6).alias("p"))


@query(PV + " select user_id, max(case when p <= i / v * 0.05e0 then p end) \"threshold\" from k group by user_id")
def k5_fdr_threshold(spark, d):
    return inference.fdr_threshold(p_values(spark, d), U, "p", 0.05)


@query(PV + ", h as (select *, list_sum(list_transform(range(1, v + 1), lambda x: 1e0 / x)) c from k) select user_id, max(case when p <= i / v * 0.05e0 / c then p end) \"threshold\" from h group by user_id")
def k5_fdr_dependent(spark, d):
    return inference.fdr_threshold(p_values(spark, d), U, "p", 0.05, dependent=True)


@query(PV + ", a as (select *, least(1, min(p * v / i) over (partition by user_id order by i desc)) adj from k), g as (select power(10e0, -6 + 5e0 * unnest(range(0, 1000)) / 999) q), m as (select user_id, p, min(adj) adj from a group by 1, 2) select user_id, p, round(coalesce(min(q), 1), 9) q from m left join g on q >= adj * (1 - 1e-9) group by 1, 2")
def k6_fdr_grid(spark, d):
    g = inference.fdr_grid(p_values(spark, d), U, "p")
    return g.groupBy("user_id", "p").agg(r(F.min("q"), 9).alias("q"))


@query(PV + ", a as (select *, least(1, min(p * v / i) over (partition by user_id order by i desc)) adj from k) select user_id, p, round(min(adj), 9) adjusted from a group by 1, 2")
def k7_fdr_adjusted(spark, d):
    a = inference.fdr_adjusted(p_values(spark, d), U, "p")
    return a.groupBy("user_id", "p").agg(r(F.min("adjusted"), 9).alias("adjusted"))


#: Shuffles of surrogate tests and permutations of models.
SHUFFLES, PERMUTATIONS = 1000, 1000

RANK = LABELLED + ", k as (select *, rank() over (partition by user_id order by s) + (count(*) over (partition by user_id, s) - 1) / 2e0 r from s), t as (select user_id, sum(c * c * c - c) t from (select user_id, count(*) c from s group by user_id, s) group by 1), w as (select user_id, count(*) filter (where y = 1) n1, count(*) filter (where y = 0) n0, sum(r) filter (where y = 1) w from k group by 1), z as (select *, sqrt(n1 * n0 / 12e0 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1)))) sp, w - n1 * (n1 + n0 + 1) / 2e0 dd from w join t using (user_id) where n1 > 0 and n0 > 0)"


@query(RANK + " select user_id, n1, n0, w, round(case when sp > 0 then (dd - 0.5 * sign(dd)) / sp end, 6) z from z")
def k8_rank_sum(spark, d):
    return inference.rank_sum(labelled(spark, d), U, "s", "y").select("user_id", "n1", "n0", "w", r("z").alias("z"))


#: Adjusted p-values of a table ``p0(..., p)``, all in one family: ``adjusted``.
FAMILY = "k as (select *, row_number() over (order by p) i, count(*) over () v from p0 where p is not null), f as (select *, least(1, min(p * v / i) over (order by i desc)) adjusted from k)"


@query(RANK + f", p0 as (select user_id, {normal_p('(dd - 0.5 * sign(dd)) / sp')} p from z where sp > 0), {FAMILY.replace('k as', 'kk as').replace('from k)', 'from kk)')} select user_id, round(p, 6) p, round(adjusted, 6) adjusted from f")
def k8_rank_sum_p(spark, d):
    z = inference.rank_sum(labelled(spark, d), U, "s", "y").withColumn("p", inference.two_sided_p("z"))
    return inference.fdr_adjusted(z, [], "p").select("user_id", r("p").alias("p"), r("adjusted").alias("adjusted"))


@query()
def k9_surrogates(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") == "view", F.col("value")).alias("b"))
    return inference.surrogate_differences(e, U, "a", "b", SHUFFLES, 5)


CHI = (
    """with c as (select user_id, event_type a, value > 100 b, count(*) o from events group by 1, 2, 3), x as (select *, sum(o) over (partition by user_id, a) r, sum(o) over (partition by user_id, b) k from c),
q as (select user_id, sum(o) * (sum(o * o / (r * k)) - 1) chi2, (count(distinct a) - 1) * (count(distinct b) - 1) dof from x group by 1), """
    + f"p0 as (select *, case dof when 1 then {normal_p('sqrt(chi2)')} when 2 then exp(-chi2 / 2) when 3 then {normal_p('sqrt(chi2)')} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) when 4 then exp(-chi2 / 2) * (1 + chi2 / 2) end p from q where dof > 0), "
    + FAMILY
)


@query(CHI + ", g as (select power(10e0, -6 + 5e0 * unnest(range(0, 1000)) / 999) q) select user_id, max(round(chi2, 6)) chi2, max(dof) dof, round(max(p), 6) p, round(coalesce(min(q), 1), 9) q from f left join g on g.q >= adjusted * (1 - 1e-9) group by user_id")
def k10_chi_square_p(spark, d):
    c = agg.chi_square(table(spark, d, "events").withColumn("high", F.col("value") > 100), U, "event_type", "high")
    g = inference.fdr_grid(c.where("dof > 0").withColumn("p", inference.chi2_p("chi2", "dof")), [], "p")
    return g.select("user_id", r("chi2").alias("chi2"), "dof", r("p").alias("p"), r("q", 9).alias("q"))


@query("select event_id, case when value / 1000 < 0.05 then '***' else '' end stars from events")
def k12_stars(spark, d):
    return table(spark, d, "events").select("event_id", C.stars(F.col("value") / 1000).alias("stars"))


# Plot data --------------------------------------------------------------------------------------


@query("select event_type, count(value) n, round(avg(value), 6) \"mean\", round(stddev_samp(value), 6) sd, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) sem_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) sem_high, round(quantile_cont(value, 0.25), 6) q1, round(median(value), 6) \"median\", round(quantile_cont(value, 0.75), 6) q3 from events group by event_type")
def v4_box(spark, d):
    b = plotdata.box(table(spark, d, "events"), ["event_type"], "value")
    return b.select("event_type", "n", *[r(c).alias(c) for c in b.columns[2:]])


@query("with b as (select event_id, event_type, value, min(value) over w a, (max(value) over w - min(value) over w) / 10 s from events window w as (partition by event_type)), c as (select *, cast(least(floor((value - a) / s), 9) as integer) bin from b), k as (select *, row_number() over (partition by event_type, bin order by value, event_id) k, count(*) over (partition by event_type, bin) n from c) select event_id, bin, round(0.5 * (k - (n + 1) / 2e0) / max(n) over (partition by event_type), 9) \"offset\" from k")
def v3_spread(spark, d):
    p = plotdata.spread_points(table(spark, d, "events"), ["event_type"], "event_id", "value")
    return p.select("event_id", "bin", r("offset", 9).alias("offset"))


@query("with h as (select event_type, cast(least(floor(value / 25), 19) as integer) bin, count(*) n from events where value >= 0 and value <= 500 group by 1, 2) select event_type, bin, (bin + 0.5e0) * 25e0 center, n, round(n / max(n) over (partition by event_type), 9) width from h")
def v2_violin(spark, d):
    v = plotdata.violin(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0, 20)
    return v.select("event_type", "bin", "center", "n", r("width", 9).alias("width"))


#: A group's outline ``h(event_type, point, center, n, step)`` with the widths of all four norms.
WIDTHS = ", m as (select *, max(n) over w m, sum(n) over w t from h window w as (partition by event_type)) select event_type, point, round(center, 6) center, round(n, 6) n, round(n / m, 6) width0, round(n / max(m) over (), 6) width1, round(n / (step * max(m / step) over ()), 6) width2, round(n / (step * t * max(m / (step * t)) over ()), 6) width3 from m"


def outlined(spark, d, kind, **options):
    rows = plotdata.violins(table(spark, d, "events"), ["event_type"], "value", kind, **options)
    rows = plotdata.violin_widths(rows, ["event_type"], {f"width{norm}": norm for norm in range(4)})
    return rows.select("event_type", "point", *[r(c).alias(c) for c in ("center", "n", "width0", "width1", "width2", "width3")])


@query("with s as (select event_type, min(value) a, (max(value) - min(value)) / 10 step from events group by 1), c as (select event_type, cast(least(floor((value - a) / step), 9) as integer) point, a, step from events join s using (event_type)), h as (select event_type, point, a + (point + 0.5e0) * step center, count(*)::double n, step from c group by event_type, point, a, step)" + WIDTHS)
def v2_even_bins(spark, d):
    return outlined(spark, d, "even")


#: Quartiles that interpolate at (i - 0.5) / n, of a sorted list ``v`` of ``n``.
QUARTILE = "greatest(1e0, least(n * {p}e0 + 0.5e0, n * 1e0)) - 1"


@query(
    f"""with o as (select event_type, list(value order by value) v, count(*) n, count(distinct value) k, min(value) a, max(value) b from events where value is not null group by 1),
q as (select *, {QUARTILE.format(p=0.25)} x1, {QUARTILE.format(p=0.75)} x3 from o),
u as (select *, v[cast(floor(x1) + 1 as bigint)] q1a, v[cast(least(floor(x1) + 2, n) as bigint)] q1b, v[cast(floor(x3) + 1 as bigint)] q3a, v[cast(least(floor(x3) + 2, n) as bigint)] q3b from q),
w as (select *, 2 * (q3a + (x3 - floor(x3)) * (q3b - q3a) - q1a - (x1 - floor(x1)) * (q1b - q1a)) / power(n, 1 / 3e0) width from u),
s as (select event_type, a, b, k < n / 3e0 discrete, greatest(1, case when n < 20 then ceil(n / 4e0) when width > 0 then round((b - a) / width) else 1 end) bins from w),
t as (select *, case when b > a then (b - a) / bins else 1 end step from s),
c as (select event_type, value, a, b, step, discrete, cast(least(floor((value - a) / step), bins - 1) as integer) point from events join t using (event_type) where value is not null),
d as (select event_type, value, count(*)::double n, value - lag(value) over (partition by event_type order by value) gap from c where discrete group by event_type, value),
h as (select event_type, point, case when b > a then a + (point + 0.5e0) * step else value end center, count(*)::double n, step from c where not discrete group by all
  union all select event_type, cast(row_number() over (partition by event_type order by value) - 1 as integer) point, value center, n, coalesce(min(gap) over (partition by event_type), 1) step from d)"""
    + WIDTHS
)
def v2_auto_bins(spark, d):
    return outlined(spark, d, "auto")


@query("with s as (select event_type, min(value) a, max(value) b, count(*) k, mad(value) / 0.6745e0 * power(4 / (3e0 * count(*)), 0.2e0) w from events group by 1), g as (select event_type, a - 3 * w f, (b - a + 6 * w) / 39 step, k, w from s), p as (select event_type, cast(i as integer) point, f + i * step center, step, k, sum(exp(-power((f + i * step - value) / w, 2) / 2)) h from events join g using (event_type), range(40) t(i) group by all), h as (select event_type, point, center, h / sum(h) over (partition by event_type) * k n, step from p)" + WIDTHS)
def v2_kernel(spark, d):
    return outlined(spark, d, "kernel", points=40)


@query()
def v2_bin_kernel(spark, d):
    return outlined(spark, d, "bin_kernel")


# Spectra ----------------------------------------------------------------------------------------


def recordings(spark, d):
    """Each user's values in order of time, as one recording."""
    e = events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))).alias("s"))
    return e.select("user_id", F.transform("s", lambda x: x["value"]).alias("samples"))


@query()
def h1_h5_spectrum(spark, d):
    return spectral.spectrum(recordings(spark, d), U, "samples", 16.0, error="chi2", fpass=(0.0, 8.0))


@query()
def h7_jackknife(spark, d):
    return spectral.spectrum(recordings(spark, d), U, "samples", 16.0, error="jackknife", fpass=(0.0, 8.0))


@query("select user_id, cast(i as integer) findex, i * 0.25e0 f from (select distinct user_id from events), (select unnest(range(0, 33)) i) where i * 0.25e0 >= 1 and i * 0.25e0 <= 4")
def h2_frequency_grid(spark, d):
    return spectral.frequency_grid(table(spark, d, "events").select("user_id").distinct(), 16.0, 64, 1.0, 4.0)


@query()
def h6_spectrogram(spark, d):
    return spectral.spectrogram(recordings(spark, d), U, "samples", 16.0, "mt", 1.0, 0.5, (0.0, 8.0))


@query()
def h8_welch(spark, d):
    return spectral.spectrogram(recordings(spark, d), U, "samples", 16.0, "welch", 2.0, 1.0, (0.0, 8.0))


@query()
def h8_wavelet(spark, d):
    return spectral.spectrogram(recordings(spark, d), U, "samples", 16.0, "wavelet", step=0.5, fpass=(1.0, 7.0))


@query()
def h8_hilbert(spark, d):
    return spectral.spectrogram(recordings(spark, d), U, "samples", 16.0, "hilbert", step=0.5, bands=((1, 3), (3, 6)))


BAND_CASE = "case when f >= 1 and f <= 4 then 'delta' when f > 4 and f <= 8 then 'theta' when f > 8 and f <= 12 then 'alpha' when f > 12 and f <= 30 then 'beta' when f > 30 and f <= 70 then 'Lgamma' end"


@query(f"select vec_id, {BAND_CASE} band, round(avg(p), 6) power from (select vec_id, cast(i as double) f, cast(embedding[i] as double) p from embeddings, (select unnest(range(1, 65)) i)) where f >= 1 group by 1, 2")
def h9_band_means(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    s = s.select("vec_id", (F.col("i") + 1).cast("double").alias("f"), F.col("x").cast("double").alias("p"))
    return spectral.band_means(s, ["vec_id"], features.BANDS, power="p").select("vec_id", "band", r("power").alias("power"))


@query("select label, round(avg(x) filter (where k = 0), 6) leftaccdelta, round(avg(x) filter (where k = 1), 6) leftaccalpha from (select label, vec_id % 2 k, cast(embedding[1] as double) x from embeddings) group by label")
def h10_feature_columns(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("k"), F.col("embedding")[0].cast("double").alias("x"))
    m = e.groupBy("label", F.when(F.col("k") == 0, "delta").otherwise("alpha").alias("band")).agg(r(F.avg("x")).alias("power"))
    m = m.withColumns({"side": F.lit("left"), "region": F.lit("acc")})
    return spectral.feature_columns(m, ["label"], "side", "region", ["leftaccdelta", "leftaccalpha"])


@query()
def h11_welch(spark, d):
    return spectral.band_powers(recordings(spark, d), U, "samples", 16.0, {"low": (1, 3), "high": (3, 8)}, 2.0, "welch")


@query()
def h11_band_powers(spark, d):
    return spectral.band_powers(recordings(spark, d), U, "samples", 16.0, {"low": (1, 3), "high": (3, 8)}, 2.0)


BAND_VALUES = "(values ('delta', 1e0, 4e0), ('theta', 4e0, 8e0), ('alpha', 8e0, 12e0), ('beta', 12e0, 30e0), ('Lgamma', 30e0, 70e0), ('Hgamma', 70e0, 100e0)) t(band, low, high)"


@query(f"with g as (select user_id, count(*) n, cast(unnest(range(0, cast(floor(count(*) / 2) as bigint) + 1)) as double) i from events group by 1) select user_id, band, low, high, count(*) bins from g, {BAND_VALUES} where i * 420.1e0 / n >= low and i * 420.1e0 / n < high group by all")
def h12_bands(spark, d):
    """Each band's number of points on the frequency grid of each recording."""
    n = F.size("samples")
    grid = recordings(spark, d).select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda i: i.cast("double") * 420.1 / n)).alias("f"))
    bands = F.broadcast(spectral.band_dimension(spark, features.BANDS))
    return grid.join(bands, (F.col("f") >= F.col("low")) & (F.col("f") < F.col("high"))).groupBy("user_id", "band", "low", "high").agg(F.count(F.lit(1)).alias("bins"))


@query()
def h13_fir(spark, d):
    return spectral.fir_filtered(recordings(spark, d), U, "samples", 16.0, 2.0, 6.0)


LOW_PASS = dsp.butterworth(4, 4.0, 16.0, "lowpass")


@query(f"with h as (select {impulse_response(LOW_PASS, 90)} h), s as (select user_id, list(value order by ts, event_id) v from events group by 1) select user_id, list_transform(range(1, len(v) + 1), lambda i: round(list_sum(list_transform(range(0, least(i, 90)), lambda k: h[k + 1] * v[i - k])), 6)) samples from s, h")
def h15_filtered(spark, d):
    done = spectral.filtered(recordings(spark, d), U, "samples", [LOW_PASS])
    return done.select("user_id", F.transform("samples", lambda v: F.round(v, 6)).alias("samples"))


@query()
def h16_preprocessed(spark, d):
    return spectral.preprocess(recordings(spark, d), U, "samples", 32.0, 1, 0.5, 6.0, 5.0)


@query()
def h16_without_artifacts(spark, d):
    return spectral.preprocess(recordings(spark, d), U, "samples", 32.0, 0, None, 6.0, artifacts=3.0)


@query("with n as (select user_id, i, avg(value) over (partition by i) m, value from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 i from events)) select user_id, i, round(value - m, 6) \"value\" from n")
def h16_rereferenced(spark, d):
    n = series.numbered(events(spark, d), U, TE).select("user_id", "i", "value")
    return spectral.rereferenced(n, [], "i", "value").select("user_id", "i", r("value").alias("value"))


@query()
def h18_band_stops(spark, d):
    spec = spark.createDataFrame([(0, 2.0, 3.0, 2), (1, 4.0, 5.0, 2), (1, 6.0, 7.0, 4)], "channel int, low double, high double, order int")
    rows = recordings(spark, d).withColumn("channel", (F.col("user_id") % 3).cast("int"))
    return spectral.filtered_by_spec(rows, spec, U, ["channel"], "samples", 16.0)


# Models -----------------------------------------------------------------------------------------


#: Components of a vector.
WIDTH = 64


def vectors(spark, d):
    """All vectors, a subject for each hundred of ids, with a score that depends on two of their features; so subjects grow in number and not in size."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("subject"), "vec_id", x.alias("x"))
    noise = F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000
    return e.withColumn("score", F.col("x")[0] - F.col("x")[3] + noise * 0.1)


def classed(spark, d):
    return agg.median_split(vectors(spark, d), ["subject"], "score", "label")


@query()
def m1_m8_lda(spark, d):
    return models.left_out(classed(spark, d), ["subject"], "x", "label", "vec_id", "lda")


@query()
def m2_m9_lda_uniform(spark, d):
    return models.cross_validated(classed(spark, d), ["subject"], "x", "label", "vec_id", "lda_uniform", folds=5, gap=1, scaling="fold")


@query()
def m4_lasso(spark, d):
    scored = models.cross_validated(vectors(spark, d), ["subject"], "x", "score", "vec_id", "lasso")
    return agg.fit_quality(scored, ["subject"], "truth", "score")


@query()
def m5_logistic(spark, d):
    return models.cross_validated(classed(spark, d), ["subject"], "x", "label", "vec_id", "logistic", folds=5)


@query()
def m6_svm(spark, d):
    return models.cross_validated(classed(spark, d), ["subject"], "x", "label", "vec_id", "svm", folds=5)


@query()
def m6_searched(spark, d):
    return models.cross_validated(classed(spark, d), ["subject"], "x", "label", "vec_id", "svm_searched", folds=5)


@query()
def m7_ridge(spark, d):
    return models.cross_validated(vectors(spark, d), ["subject"], "x", "score", "vec_id", "ridge", folds=3)


@query()
def m10_hold_out(spark, d):
    rows = series.chronological_split(classed(spark, d), ["subject"], ["vec_id"])
    return models.transfer(rows.where("not is_test"), rows.where("is_test"), ["subject"], "x", "label", "vec_id", permutations=PERMUTATIONS)


@query()
def m11_transfer(spark, d):
    one = classed(spark, d)
    other = one.withColumn("subject", F.col("subject") - 1)  # each subject and the next one, under the first one's number
    there = models.transfer(one, other, ["subject"], "x", "label", "vec_id").withColumn("way", F.lit("there"))
    return there.unionByName(models.transfer(other, one, ["subject"], "x", "label", "vec_id").withColumn("way", F.lit("back")))


@query()
def m12_grid(spark, d):
    subsets = {"all": range(WIDTH), "left": range(WIDTH // 2), "right": range(WIDTH // 2, WIDTH)}
    g = analyses.grid(vectors(spark, d), "subject", "vec_id", "x", "score", subsets, permutations=PERMUTATIONS, folds=10)
    return g.withColumn("result", C.result_text("auc", "p"))


@query()
def m12_lasso_grid(spark, d):
    subsets = {"all": range(WIDTH), "left": range(WIDTH // 2), "right": range(WIDTH // 2, WIDTH)}
    return analyses.regression_grid(vectors(spark, d), "subject", "vec_id", "x", "score", subsets, permutations=PERMUTATIONS, folds=10)


@query()
def m14_limits(spark, d):
    c = agg.confusion(labelled(spark, d), U, "y", "s", 0.1)
    return c.withColumn("l", models.share_limits("tp", F.col("tp") + F.col("fn"))).select("user_id", "tp", "fn", "l.low", "l.high")


@query("select vec_id, [round((e[1] - m1) * 2, 6), round((e[2] - m2) * -1, 6)] shap from (select vec_id, cast(embedding[1:2] as double[]) e, avg(cast(embedding[1] as double)) over (partition by label) m1, avg(cast(embedding[2] as double)) over (partition by label) m2 from embeddings)")
def m15_shap(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))
    e = agg.with_stats(e, ["label"], a=F.avg(F.col("x")[0]), b=F.avg(F.col("x")[1]))
    shap = models.linear_shap(F.array(F.lit(2.0), F.lit(-1.0)), F.col("x"), F.array("a", "b"))
    return e.select("vec_id", F.transform(shap, lambda v: F.round(v, 6)).alias("shap"))


@query()
def m16_coefficients(spark, d):
    c = models.coefficients(classed(spark, d), ["subject"], "x", "label", "vec_id", [f"f{i}" for i in range(WIDTH)])
    return plotdata.heatmap(c, ["subject"])


@query()
def k1_permutations(spark, d):
    areas = models.statistics(classed(spark, d), ["subject"], "x", "label", "vec_id", "lda", folds=10, permutations=PERMUTATIONS)
    return inference.permutation_p_among(areas, ["subject"], ["auc"])


@query()
def k1_regressions(spark, d):
    found = models.statistics(vectors(spark, d), ["subject"], "x", "score", "vec_id", "lasso", "regression", permutations=PERMUTATIONS)
    return inference.permutation_p_among(found, ["subject"], ["r2", "rho"])


@query()
def v6_swarm(spark, d):
    areas = models.statistics(classed(spark, d), ["subject"], "x", "label", "vec_id", "lda", folds=5, permutations=PERMUTATIONS)
    return plotdata.swarm_among(areas, ["subject"], "auc")


# State space ------------------------------------------------------------------------------------


#: Block rows of past and future, and orders of which the one with the least AIC is taken.
HORIZON, ORDERS = 10, range(1, 21)


def state_series(spark, d):
    """Each user's two-dimensional series, in order of time, in recordings of six samples."""
    e = events(spark, d).withColumnRenamed("user_id", "subject")
    n = series.numbered(e, ["subject"], TE)
    return n.select("subject", "i", F.array("value", F.length("event_type").cast("double")).alias("x"), F.floor(F.col("i") / 6).alias("recording"))


@query(EV + ", n as (select user_id, row_number() over (partition by user_id order by t, event_id) - 1 i, value a, lead(value) over (partition by user_id order by t, event_id) b from ev) select user_id, i, [a, b] h from n where b is not null")
def j1_hankel(spark, d):
    n = series.numbered(events(spark, d), U, TE)
    return statespace.hankel_columns(n, U, "i", ["value"], 2)


@query()
def j2_j7_fitted(spark, d):
    return statespace.fitted(state_series(spark, d), ["subject"], "i", "x", HORIZON, ORDERS).select("subject", "n", "aic")


@query()
def j2_j3_stable(spark, d):
    return statespace.fitted(state_series(spark, d), ["subject"], "i", "x", HORIZON, ORDERS, "sv", stable=True).select("subject", "n", "aic", "a", "solved")


@query()
def j6_j8_states(spark, d):
    return statespace.recording_states(state_series(spark, d), ["subject"], "recording", "i", "x", HORIZON, ORDERS)


@query()
def j2_inputs(spark, d):
    """Values of each user's events as the output of a system whose input is the length of the event's type."""
    s = state_series(spark, d).select("subject", "i", F.slice("x", 1, 1).alias("y"), F.slice("x", 2, 1).alias("u"))
    return statespace.fitted_with_inputs(s, ["subject"], "i", "y", "u", 5, range(1, 6))


@query()
def j2_planted(spark, d):
    """A planted system, driven by each user's values with noise from their ids: what comes out at once, and one, two and three samples after an input."""
    by = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-60, 0)
    e = events(spark, d).withColumn("v", F.col("value") / 100)
    e = series.numbered(e.withColumn("past", F.reverse(F.collect_list("v").over(by))), U, TE)
    response = F.aggregate(F.transform("past", lambda v, k: v * F.when(k == 0, 0.2).otherwise(0.5 * F.pow(F.lit(0.7), k - 1))), F.lit(0.0), lambda a, b: a + b)
    noise = (F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 - 0.5) * 0.02
    s = e.select(F.col("user_id").alias("subject"), "i", F.array(response + noise).alias("y"), F.array("v").alias("u"))
    m = statespace.fitted_with_inputs(s, ["subject"], "i", "y", "u", 5, range(1, 6))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda p, q: p + q)

    def times_a(row):
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: dot(row, F.transform("a", lambda r: F.get(r, j))))

    rows = [F.col("c")[0]]
    for _ in range(2):
        rows.append(times_a(rows[-1]))
    b = F.transform("b", lambda r: r[0])
    return m.select("subject", "n", F.col("d")[0][0].alias("at_once"), *[dot(row, b).alias(f"after_{k + 1}") for k, row in enumerate(rows)])


@query(EV + ", n as (select user_id, floor((row_number() over (partition by user_id order by t, event_id) - 1) / 5) trial from ev), b as (select user_id, min(trial) a, max(trial) z from n group by 1) select n.user_id, cast(run as bigint) run, is_warm_up, count(*) n from (select user_id, trial run, false is_warm_up from n union all select user_id, trial + 1, true from n) n join b using (user_id) where run > a and run <= z group by 1, 2, 3")
def j9_warmed(spark, d):
    n = series.numbered(events(spark, d), U, TE).withColumn("trial", F.floor(F.col("i") / 5))
    return statespace.warmed_trials(n, U, "trial").groupBy("user_id", "run", "is_warm_up").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_type, round(avg(value), 6) power from events group by 1, 2")
def j10_mean_power(spark, d):
    return statespace.mean_power(table(spark, d, "events"), ["user_id", "event_type"], "value").withColumn("power", r("power"))


@query()
def m19_state_decoding(spark, d):
    s = state_series(spark, d)
    score = s.groupBy("subject", "recording").agg(F.avg(F.col("x")[0]).alias("y"))
    return analyses.state_decoding(s, "subject", "recording", "i", "x", score, "y", HORIZON, ORDERS, permutations=PERMUTATIONS)


# Streams ----------------------------------------------------------------------------------------


def _streamed(spark, frame: DataFrame, name: str) -> DataFrame:
    """What a stream yields until its input ends."""
    path = writers.scratch_path(spark, name)
    frame.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    return files.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def closed_stream(spark, d):
    """``event_stream``, and a row of no user a day after the last event, so that every event's turn comes."""
    last = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).first()[0]
    events = event_stream(spark, d)
    schema = ", ".join(f"{n} {k}" for n, k in events.dtypes)
    end = stateful.closing(spark, writers.scratch_path(spark, "closing"), schema, F.lit(last))
    return events.unionByName(end)


STREAM_PASS = dsp.butterworth(2, 2.0, 16.0, "lowpass")
IN_ORDER = "s as (select user_id, list(epoch_us(ts) order by ts) t, list(value order by ts) v from events group by 1), n as (select *, unnest(range(1, len(v) + 1)) i from s)"


@query(f"with h as (select {impulse_response(STREAM_PASS, 120)} h), {IN_ORDER} select user_id, t[i] t, round(list_sum(list_transform(range(0, least(i, 120)), lambda k: h[k + 1] * v[i - k])), 6) \"value\" from n, h")
def t1_filter_stream(spark, d):
    rows = closed_stream(spark, d).withColumn("t", F.unix_micros("ts"))
    return _streamed(spark, stateful.filter_stream(rows, "user_id", "t", "value", STREAM_PASS), "filtered").withColumn("value", r("value"))


@query(f"with {IN_ORDER} select user_id, t[i] t, [round(coalesce(list_sum(list_transform(range(1, i), lambda k: 0.3e0 * power(0.6e0, i - 1 - k) * v[k])), 0), 6)] state from n")
def t2_kalman_stream(spark, d):
    import numpy as np

    rows = closed_stream(spark, d).select("user_id", F.unix_micros("ts").alias("t"), F.array("value").alias("x"))
    a, c, k = np.array([[0.9]]), np.array([[1.0]]), np.array([[0.3]])
    found = _streamed(spark, stateful.kalman_stream(rows, "user_id", "t", "x", a, c, k), "states")
    return found.withColumn("state", F.transform("state", lambda v: F.round(v, 6)))


@query("select event_type, epoch_us(date_trunc('day', ts)) \"start\", count(value) n, round(avg(value * value), 6) power from events group by event_type, date_trunc('day', ts) having date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 day from events)")
def t3_window_power(spark, d):
    p = _streamed(spark, stateful.window_power(event_stream(spark, d), ["event_type"], "ts", "value", "1 day", "1 day"), "power")
    return p.select("event_type", F.unix_micros("start").alias("start"), "n", r("power").alias("power"))


# More of the inventory --------------------------------------------------------------------------


@query("select r_regionkey, r_name from region")
def a4_a6_csv(spark, d):
    path = writers.scratch_path(spark, "csv")
    writers.write_csv(table(spark, d, "region").withColumn("_c0", F.lit(0)).select("_c0", "r_regionkey", "r_name"), path, single=True)
    return readers.read_csv_table(spark, path, "_c0 int, r_regionkey int, r_name string", "_c0")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders")
def a5_a7_parquet(spark, d):
    path = writers.scratch_path(spark, "results")
    writers.write_results(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, ["o_orderstatus"])
    return readers.read_recordings(spark, path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem")
def b7_tokens(spark, d):
    df = table(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *features.matching(df.columns, "return", "flag", "l_"))


@query(EV + " select event_id from ev where nv is not null and value is not null and event_type is not null")
def b10_complete(spark, d):
    return events(spark, d).dropna("any", subset=["nv", "value", "event_type"]).select("event_id")


@query("select event_id from events where nullif(event_type, '') is not null")
def b11_not_empty(spark, d):
    return table(spark, d, "events").where(F.nullif("event_type", F.lit("")).isNotNull()).select("event_id")


@query(_levinson("event_type", 5, "a.n"))
def e5_durbin_levinson(spark, d):
    a = series.autocovariance(events(spark, d), ["event_type"], "event_id", "value", 5)
    return series.partial_autocorrelation(a, ["event_type"]).withColumn("pacf", r("pacf"))


@query("select l_orderkey, list(l_linenumber order by l_linenumber desc) sizes from lineitem group by l_orderkey")
def s2_sorted_sizes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber"), asc=False).alias("sizes"))


DESIGNS = {kind: dsp.butterworth(4, cut, 16.0, kind) for kind, cut in (("lowpass", 4.0), ("highpass", 1.0), ("bandstop", (3.0, 5.0)))}


def convolved(responses: Mapping[str, str]) -> str:
    """SQL of recordings through filters of the given responses (lists) by kind; what rounds to 0 has no sign, as DuckDB's ``round`` would leave it."""
    each = " union all ".join(f"select '{kind}' kind, {h} h" for kind, h in responses.items())
    return f"with h as ({each}), s as (select user_id, list(value order by ts, event_id) v from events group by 1) select user_id, kind, list_transform(range(1, len(v) + 1), lambda i: round(list_sum(list_transform(range(0, least(i, len(h))), lambda k: h[k + 1] * v[i - k])), 5) + 0e0) samples from s, h"


@query(convolved({kind: impulse_response(sos, 240) for kind, sos in DESIGNS.items()}))
def h14_designs(spark, d):
    """Recordings through each of the designed filters."""
    made = [spectral.filtered(recordings(spark, d), U, "samples", [sos]).withColumn("kind", F.lit(kind)) for kind, sos in DESIGNS.items()]
    return sets.stacked(made).select("user_id", "kind", F.transform("samples", lambda v: F.round(v, 5)).alias("samples"))


@query()
def h20_recordings(spark, d):
    rows = recordings(spark, d).withColumns({"contact": F.lit("E3E1"), "start_us": F.lit(0).cast("long"), "fs": F.lit(16.0), "subject": F.floor(F.col("user_id") / 5)})  # a subject for five users
    gone = spark.createDataFrame([(1, 2), (2, 5)], "subject long, ordinal long")
    loaded = recording_plans.load_recordings(rows, U, "samples", "contact", "start_us", "fs", 64, gone, ["subject"])
    return recording_plans.quiet_recordings(loaded, ["subject"], "samples").select("user_id", "subject", "contact_1", "contact_2", "end_us", "sd")


@query()
def h21_power_features(spark, d):
    rows = recordings(spark, d).withColumns({"channel": F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), "pair": F.floor(F.col("user_id") / 2)})
    return recording_plans.power_features(rows, ["pair"], "channel", "samples", 16.0, {"low": (1, 4), "high": (4, 8)}, ["a", "b"], line=5.0)


@query()
def h22_synced_temperature(spark, d):
    e = events(spark, d).dropDuplicates(["user_id", "t"])
    marks = e.where("event_type = 'view'").select("user_id", "t", "event_id")
    return recording_plans.synced_temperature(marks, e.select("user_id", "t", "value"), "t", U, "value", 16.0, 3_600_000_000)


@query(
    """with e as (select cast(floor(vec_id / 100) as bigint) subject, vec_id, cast(embedding as double[]) e from embeddings), u as (select subject, vec_id, unnest(e) x, generate_subscripts(e, 1) i from e),
c as (select subject, vec_id, i, x - avg(x) over (partition by subject, i) x from u), v as (select subject, vec_id, list(x order by i) x, sum(x * x) q, count(*) p from c group by 1, 2),
s as (select a.subject, sum(power(list_dot_product(a.x, b.x), 2)) ss from v a join v b using (subject) group by 1), t as (select subject, count(*) n, max(p) p, sum(q) / count(*) tr, sum(q * q) / count(*) qq from v group by 1)
select subject, round(greatest(0, least(1, (qq - ss / n / n) / n / (ss / n / n - tr * tr / p))), 6) intensity, round(tr, 6) "trace" from s join t using (subject)"""
)
def m3_shrinkage(spark, d):
    m = models.shrinkage(vectors(spark, d), ["subject"], "x")
    return m.select("subject", r("intensity").alias("intensity"), r("trace").alias("trace"))


@query()
def m13_targets(spark, d):
    rows = vectors(spark, d)
    half = {"left": F.slice("x", 1, WIDTH // 2), "right": F.slice("x", WIDTH // 2 + 1, WIDTH // 2)}
    parts = [rows.withColumns({"score": F.col("x")[i], "target": F.lit(f"f{i}"), "side": F.lit(n), "x": x}) for i in (0, 1) for n, x in half.items()]
    key = ["subject", "side", "target"]
    labelled_rows = agg.median_split(sets.stacked(parts), key, "score", "label")
    areas = models.statistics(labelled_rows, key, "x", "label", "vec_id", "lda", folds=5, permutations=PERMUTATIONS)
    report = inference.permutation_p_among(areas, key, ["auc"])
    return report.withColumn("result", C.result_text("auc", "p"))


@query()
def m17_predictions(spark, d):
    scored = models.cross_validated(classed(spark, d), ["subject"], "x", "label", "vec_id", "lda", folds=10)
    return scored.select("subject", "vec_id", "truth", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def m18_acute_decoding(spark, d):
    rows = agg.median_split(vectors(spark, d), ["subject"], "score", "label", strict=True)
    logit = models.cross_validated(rows, ["subject"], "x", "label", "vec_id", "logistic", folds=5)
    ridge = models.cross_validated(rows, ["subject"], "x", "score", "vec_id", "ridge", folds=3)
    return agg.auc(logit, ["subject"], "truth", "score").join(agg.fit_quality(ridge, ["subject"], "truth", "score").select("subject", "r2"), "subject", "left")


@query()
def k2_k3_null_table(spark, d):
    rows = series.chronological_split(classed(spark, d), ["subject"], ["vec_id"])
    areas = models.transfer_areas(rows.where("not is_test"), rows.where("is_test"), ["subject"], "x", "label", "vec_id", permutations=PERMUTATIONS)
    return inference.permutation_p_among(areas, ["subject"], ["auc"], strict=False)


@query()
def k11_compared_bouts(spark, d):
    e = series.numbered(events(spark, d), U, TE).withColumns({"trial": F.floor(F.col("i") / 12), "subject": F.col("user_id")})
    e = e.withColumn("trial", F.col("user_id") * 1000 + F.col("trial")).withColumn("y", (F.col("trial") % 2).cast("int"))
    return recording_plans.compared_bouts(e, "subject", "trial", TE, "value", "y", 30.0)


@query()
def v7_heatmap(spark, d):
    c = models.coefficients(classed(spark, d), ["subject"], "x", "label", "vec_id", [f"f{i}" for i in range(WIDTH)], "lasso")
    return sets.pivoted(plotdata.heatmap(c, ["subject"]), ["subject"], "name", [f"f{i}" for i in range(WIDTH)], F.first("scaled"))


@query("select event_id, epoch_us(ts) t, value from events")
def a1_a2_files(spark, d):
    path = writers.scratch_path(spark, "records")
    events(spark, d).select(F.col("ts").cast("string").alias("time"), "event_id", "t", "value").write.json(path)
    return readers.read_timetable(spark, path, "time string, event_id long, t long, value double", "time", ["value"], ["event_id"], multi_line=False).select("event_id", "t", "value")


@query("select vec_id, cast(embedding[1] as double) leftaccdelta, cast(embedding[3] as double) leftaccalpha, cast(embedding[6] as double) \"leftaccHgamma\" from embeddings")
def b6_region_columns(spark, d):
    names = features.feature_names()
    wide = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    own = features.FeatureSet("left acc", "left", "acc").columns(wide.columns)
    return wide.select("vec_id", *own).select("vec_id", "leftaccdelta", "leftaccalpha", "leftaccHgamma")


@query(EV + " select event_id, t from ev order by t, event_id")
def e11_by_time(spark, d):
    return series.by_time(events(spark, d).select("event_id", "t"), "t", "event_id")


@query("select user_id, cast(fold as integer) fold, count(*) n from (select user_id, ntile(4) over (partition by user_id order by event_id) fold from events) group by 1, 2")
def e15_shuffled_folds(spark, d):
    return series.k_folds(events(spark, d), U, TE, 4, seed=1).groupBy("user_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, cast(regexp_extract('nrs_smooth' || user_id, '_smooth([0-9]+)', 1) as integer) width from events group by user_id")
def g_smoothing(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", C.smoothing_width(F.concat(F.lit("nrs_smooth"), "user_id")).alias("width"))


@query("select user_id, count(*) filter (where event_type = 'click') clicks, count(distinct event_type) kinds from events group by user_id")
def g_map(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.size(F.map_keys("m")).cast("long").alias("kinds"))


@query()
def h8_options(spark, d):
    part = spectral.between(recordings(spark, d), "samples", 16.0, 0.5, 3.5)
    rows = spectral.spectrogram(part, U, "samples", 16.0, "mt", 1.0, 0.5, (0.0, 8.0))
    scored = spectral.log_scaled(rows, U, z=True).withColumn("half", F.col("user_id") % 2)
    return spectral.trial_mean(scored, ["half"])


@query()
def h7_finite_size(spark, d):
    return spectral.spectrum(recordings(spark, d), U, "samples", 16.0, error="chi2", fpass=(0.0, 8.0), finite_size=True)


@query("select user_id, position, kind, low, high, \"order\", len samples from (select user_id, count(*) len from events group by 1), (values (0, 'bandstop', 66e0, 70e0, 4), (1, 'bandstop', 81e0, 85e0, 4), (2, 'bandstop', 103e0, 107e0, 4), (3, 'bandstop', 103e0, 107e0, 4), (4, 'bandstop', 126e0, 130e0, 4), (5, 'highpass', 1e0, null, 4)) t(position, kind, low, high, \"order\") where low < len")
def h19_acute_filters(spark, d):
    """The filters below the rate of each recording, were its samples those of two seconds."""
    rows = recordings(spark, d).select("user_id", F.size("samples").cast("long").alias("samples"))
    return rows.join(F.broadcast(spectral.acute_filters(spark)), F.col("low") < F.col("samples")).select("user_id", "position", "kind", "low", "high", "order", "samples")


@query()
def h19_acute_filtered(spark, d):
    return spectral.acute_filtered(recordings(spark, d), U, "samples", 420.1)


LEAST_SQUARES = dsp.fir_least_squares(24, [0, 0.2, 0.3, 0.6, 0.7, 1], [0, 0, 1, 1, 0, 0])


@query(convolved({"band": "[" + ", ".join(f"{v:.17e}" for v in LEAST_SQUARES) + "]"}).replace("user_id, kind,", "user_id,"))
def h13_least_squares(spark, d):
    """Recordings through a band-pass filter that is designed by least squares, causally."""
    made = spectral.convolved(recordings(spark, d), U, "samples", LEAST_SQUARES)
    return made.select("user_id", F.transform("samples", lambda v: F.round(v, 5)).alias("samples"))


@query()
def m12_regions(spark, d):
    names = features.feature_names()
    rows = vectors(spark, d).withColumn("x", F.slice("x", 1, len(names)))
    return analyses.region_grid(rows, "subject", "vec_id", "x", names, "score", F.col("subject") % 4 == 0, permutations=PERMUTATIONS, folds=10)


@query()
def m14_optimal(spark, d):
    return analyses.optimal_metrics(labelled(spark, d), U, "y", "s")
