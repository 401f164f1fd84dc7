"""The operators as queries over the driver's tables, each with SQL for the same rows.

Channels are users or labels, pulses are vectors as whole numbers, heights are prices, and times are event times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators import cuts, histograms, jumps, pulse_stats, temporal
from pulseloom.plans.channels import mapped, write_by_channel

PRE, N = 16, 64
WEIGHTS = [((k * 7) % 11) - 5 for k in range(N)]
WEIGHTS60 = [((k * 5) % 13) - 6 for k in range(N - 4)]
ARRIVAL = [((k * 3) % 7) - 3 for k in range(N)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _pulses(spark, sf_dir) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int") + 5000)
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", whole.alias("pulse"))


def _rounded(x, digits: int):
    """Rounded as DuckDB does: scaled in double precision, then half away from zero.  F.round takes the shortest decimal instead, and so differs next to a half."""
    y = F.abs(x) * 10.0**digits
    whole = F.rint(y)
    return F.signum(x) * (whole + F.when(y - whole == 0.5, 1.0).otherwise(0.0)) / 10.0**digits


_P = "p AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::INT + 5000) AS pulse FROM embeddings)"
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05")
def good_rows(spark, sf_dir):
    return cuts.good(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 10, F.col("l_discount") < 0.05).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE NOT (l_quantity > 10)")
def bad_rows(spark, sf_dir):
    return cuts.bad(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, sqrt(l_quantity) AS root, round(l_extendedprice * (1 - l_discount), 4) AS net, abs(l_tax - l_discount) < 0.02 AS near FROM lineitem")
def columns_math(spark, sf_dir):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sqrt("l_quantity").alias("root"), net.alias("net"), (F.abs(F.col("l_tax") - F.col("l_discount")) < 0.02).alias("near"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'cheap' WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 20 THEN 'many' ELSE 'fallback' END AS category FROM lineitem")
def categorize_last_wins(spark, sf_dir):
    chosen = P.categorize({"many": F.col("l_quantity") > 20, "bulk": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.08})
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("category"))


@query("SELECT event_id, strftime(timezone('America/Denver', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local_time FROM events")
def timezone_convert(spark, sf_dir):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Denver"), F.col("ts"))
    return _t(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def head_rows(spark, sf_dir):
    return cuts.head(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 5).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 60")
def head_all_but(spark, sf_dir):
    return cuts.head(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], -60).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4")
def tail_rows(spark, sf_dir):
    return cuts.tail(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 4).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 7 = 3")
def every_seventh(spark, sf_dir):
    return cuts.every_nth(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 7, 2).select("user_id", "event_id")


@query()
def sample_rows(spark, sf_dir):
    return cuts.sample(_t(spark, sf_dir, "events"), ["user_id"], 3, 11).select("user_id", "event_id")


@query("""WITH c AS (SELECT (CASE WHEN l_extendedprice = 0 THEN 0 ELSE ceil(l_extendedprice / 500.0) - 1 END)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1)
SELECT b::INT AS bin, (b + 1.0::DOUBLE) * 500.0 AS label, coalesce(n, 0)::BIGINT AS n_rows FROM range(200) t(b) LEFT JOIN c ON c.bin = b""")
def hist_uniform(spark, sf_dir):
    return histograms.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 500.0, 200)


@query("""WITH c AS (SELECT event_type, (CASE WHEN value = 0 THEN 0 ELSE ceil(value / 25.0) - 1 END)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL)
SELECT g.event_type, b::INT AS bin, (b + 1.0::DOUBLE) * 25.0 AS label, coalesce(n, 0)::BIGINT AS n_rows FROM (SELECT DISTINCT event_type FROM events) g CROSS JOIN range(20) t(b) LEFT JOIN c ON c.bin = b AND c.event_type = g.event_type""")
def hist_grouped(spark, sf_dir):
    return histograms.histogram(_t(spark, sf_dir, "events"), "value", 0.0, 25.0, 20, ["event_type"])


_MAD = "m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id), s AS (SELECT e.user_id, any_value(med) AS med, median(abs(value - med)) * 1.4826 AS smad FROM events e JOIN m USING (user_id) GROUP BY e.user_id)"


@query(f"WITH {_MAD} SELECT event_id FROM events JOIN s USING (user_id) WHERE value < med + 2.0 * smad")
def mad_cut_above(spark, sf_dir):
    return cuts.cut_above(_t(spark, sf_dir, "events"), ["user_id"], "value", 2.0).select("event_id")


@query(f"WITH {_MAD} SELECT event_id FROM events JOIN s USING (user_id) WHERE value BETWEEN 0 AND med + 1.5 * smad")
def mad_cut_positive(spark, sf_dir):
    return cuts.cut_positive(_t(spark, sf_dir, "events"), ["user_id"], "value", 1.5).select("event_id")


@query(f"WITH {_MAD} SELECT event_id FROM events JOIN s USING (user_id) WHERE value BETWEEN med - 1.0 * smad AND med + 1.0 * smad")
def mad_cut_around(spark, sf_dir):
    return cuts.cut_around(_t(spark, sf_dir, "events"), ["user_id"], "value", 1.0).select("event_id")


@query(f"WITH {_MAD} SELECT event_id FROM events JOIN s USING (user_id) WHERE value BETWEEN med - 30 AND med + 90")
def median_range_cut(spark, sf_dir):
    return cuts.cut_range(_t(spark, sf_dir, "events"), ["user_id"], "value", 30.0, 90.0).select("event_id")


_FLAGSHIP = f"""WITH {_MAD}, g AS (SELECT user_id, value FROM events JOIN s USING (user_id) WHERE value < med + 2.0 * smad),
c AS (SELECT user_id, (CASE WHEN value = 0 THEN 0 ELSE ceil(value / 50.0) - 1 END)::INT AS bin, count(*) AS n FROM g WHERE value BETWEEN 0 AND 500 GROUP BY ALL)
SELECT u.user_id, b::INT AS bin, (b + 1.0::DOUBLE) * 50.0 AS label, coalesce(n, 0)::BIGINT AS n_rows FROM (SELECT DISTINCT user_id FROM g) u CROSS JOIN range(10) t(b) LEFT JOIN c ON c.bin = b AND c.user_id = u.user_id"""


@query(_FLAGSHIP)
def channel_spectra(spark, sf_dir):
    kept = cuts.cut_above(_t(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], "value", 2.0)
    return histograms.histogram(kept, "value", 0.0, 50.0, 10, ["user_id"])


@query("""WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1),
d AS (SELECT o_orderpriority, median(abs(o_totalprice - med)) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1)
SELECT o_orderpriority, round((quantile_cont(o_totalprice, 0.25) + 2 * quantile_cont(o_totalprice, 0.5) + quantile_cont(o_totalprice, 0.75)) / 4, 4) AS trimean,
round(any_value(mad) / 0.674480, 4) AS mad, round(sqrt(avg(o_totalprice * o_totalprice)), 3) AS rms, min(CASE WHEN o_totalprice > 0 THEN o_totalprice END) AS least_positive FROM orders JOIN d USING (o_orderpriority) GROUP BY o_orderpriority""")
def robust_statistics(spark, sf_dir):
    r = pulse_stats.robust(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return r.select("o_orderpriority", F.round("trimean", 4).alias("trimean"), F.round("mad", 4).alias("mad"), F.round("rms", 3).alias("rms"), "least_positive")


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.user_id, min(b.value - a.value) AS shorth FROM p a JOIN p b ON a.user_id = b.user_id AND b.k = a.k + a.n // 2 GROUP BY a.user_id""")
def shorth_range(spark, sf_dir):
    return pulse_stats.shortest_half(_t(spark, sf_dir, "events"), ["user_id"], "value")


@query("""WITH g AS (SELECT user_id, value AS x, sum(event_id % 5 + 1) AS w FROM events GROUP BY ALL),
c AS (SELECT user_id, x, sum(w) OVER (PARTITION BY user_id ORDER BY x) AS c, sum(w) OVER (PARTITION BY user_id) AS t FROM g)
SELECT user_id, min(x) AS high_median FROM c WHERE 2 * c > t GROUP BY user_id""")
def weighted_high_median(spark, sf_dir):
    return pulse_stats.high_median(_t(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 5 + 1), ["user_id"], "value", "w")


@query("""WITH c AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id),
w AS (SELECT user_id, value, greatest(1 - ((value - m) / 200.0) * ((value - m) / 200.0), 0) ** 2 AS w FROM events JOIN c USING (user_id))
SELECT user_id, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY user_id""")
def bisquare_step(spark, sf_dir):
    return pulse_stats.weighted_mean(_t(spark, sf_dir, "events"), ["user_id"], "value", 200.0, "bisquare", 1).select("user_id", F.round("value", 6).alias("value"))


@query("""WITH c AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id),
w AS (SELECT user_id, value, CASE WHEN abs((value - m) / 40.0) <= 1 THEN 1.0::DOUBLE ELSE 1.0 / abs((value - m) / 40.0) END AS w FROM events JOIN c USING (user_id)),
d AS (SELECT user_id, sum(w * value) / sum(w) AS m FROM w GROUP BY user_id),
v AS (SELECT user_id, value, CASE WHEN abs((value - m) / 40.0) <= 1 THEN 1.0::DOUBLE ELSE 1.0 / abs((value - m) / 40.0) END AS w FROM events JOIN d USING (user_id))
SELECT user_id, round(sum(w * value) / sum(w), 6) AS value FROM v GROUP BY user_id""")
def huber_two_steps(spark, sf_dir):
    return pulse_stats.weighted_mean(_t(spark, sf_dir, "events"), ["user_id"], "value", 40.0, "huber", 2).select("user_id", F.round("value", 6).alias("value"))


_STATES = "t AS (SELECT us, max(event_id) AS event_id FROM e WHERE event_type = 'signup' GROUP BY us)"


@query(f"""WITH {_E}, t AS (SELECT user_id, us, max(event_id) AS state FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, coalesce(t.state, -1) AS state FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.us >= t.us""")
def asof_state(spark, sf_dir):
    e = _events(spark, sf_dir)
    states = e.where("event_type = 'signup'").select("user_id", "us", F.col("event_id").alias("state"), "event_id")
    found = temporal.asof(e.select("user_id", "us", F.col("event_id").alias("id")), states.select("user_id", "us", "state", F.col("event_id").alias("tie_id")), ["user_id"], "us", "state", tie=["tie_id"])
    return found.select(F.col("id").alias("event_id"), F.coalesce("state", F.lit(-1)).alias("state"))


@query(f"""WITH {_E}, t AS (SELECT user_id, us, max(event_id) AS state FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, coalesce(t.state, -1) AS state FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.us >= t.us""")
def asof_state_slotted(spark, sf_dir):
    e = _events(spark, sf_dir)
    states = e.where("event_type = 'signup'").select("user_id", "us", F.col("event_id").alias("state"), F.col("event_id").alias("tie_id"))
    found = temporal.asof(e.select("user_id", "us", F.col("event_id").alias("id")), states, ["user_id"], "us", "state", tie=["tie_id"], slot=86_400e6 * 3)
    return found.select(F.col("id").alias("event_id"), F.coalesce("state", F.lit(-1)).alias("state"))


@query(f"""WITH {_E}, t AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'error'),
b AS (SELECT e.event_id, e.user_id, e.us, t.us AS prev FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.us >= t.us),
f AS (SELECT b.*, t.us AS next FROM b ASOF LEFT JOIN t ON b.user_id = t.user_id AND b.us <= t.us)
SELECT event_id, (us - prev) * 0.001::DOUBLE AS ms_since, (next - us) * 0.001::DOUBLE AS ms_until, CASE WHEN us - prev < next - us THEN (us - prev) * 0.001::DOUBLE ELSE -((next - us) * 0.001::DOUBLE) END AS ms_nearest FROM f""")
def trigger_distances(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return temporal.trigger_distances(e.drop("event_type"), e.where("event_type = 'error'").select("user_id", "us"), ["user_id"], "us", 0.001).select("event_id", "ms_since", "ms_until", "ms_nearest")


@query(f"""WITH {_E}, t AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'purchase'),
b AS (SELECT e.event_id, e.user_id, e.us, t.us AS p FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.us >= t.us),
f AS (SELECT b.*, t.us AS n FROM b ASOF LEFT JOIN t ON b.user_id = t.user_id AND b.us <= t.us)
SELECT event_id, CASE WHEN n IS NULL OR us - p <= n - us THEN p ELSE n END AS near_us FROM f""")
def asof_nearest(spark, sf_dir):
    e = _events(spark, sf_dir)
    found = temporal.asof_nearest(e.select("event_id", "user_id", "us"), e.where("event_type = 'purchase'").select("user_id", "us", F.col("us").alias("near_us")), ["user_id"], "us", "near_us")
    return found.select("event_id", "near_us")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
def running_maximum(spark, sf_dir):
    return temporal.monotonic(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value").select("event_id", "value")


@query("""WITH c AS (SELECT event_id, user_id, (sum(value::DECIMAL(12,2)) OVER (PARTITION BY user_id ORDER BY event_id)) AS s FROM events),
m AS (SELECT *, s % 100 AS m FROM c), d AS (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM m)
SELECT event_id, (m + sum(CASE WHEN d > 50 THEN -100 WHEN d < -50 OR d = -50 THEN CASE WHEN d = -50 THEN 0 ELSE 100 END ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS flat FROM d""")
def unwrap_jumps(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("event_id")
    running = _t(spark, sf_dir, "events").withColumn("s", F.sum(F.col("value").cast("decimal(12,2)")).over(by).cast("decimal(22,2)"))
    out = temporal.unwrap(running, "s", F.lit(100).cast("decimal(22,2)"), ["user_id"], ["event_id"], "flat")
    return out.select("event_id", F.col("flat").cast("double").alias("flat"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS concat_state FROM orders")
def concat_states(spark, sf_dir):
    o, day = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), F.col("o_orderdate")
    parts = [o.where(day < "1995-01-01"), o.where((day >= "1995-01-01") & (day < "1997-01-01")), o.where(day >= "1997-01-01")]
    return temporal.concat_states(parts).drop("o_orderdate")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 400) AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def channels_semi_anti(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    wanted = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return cuts.among(cuts.without(e, e.where("event_type = 'error' and value > 400"), ["user_id"]), wanted, ["user_id"]).select("event_id")


@query(f"""WITH {_E}, g AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS n FROM e),
w AS (SELECT user_id, us + 1000000 + k * 3600000000 AS start FROM g, unnest(range(0, ((n - us - 1000000) // 3600000000)::BIGINT)) t(k) WHERE n - us - 1000000 >= 3600000000)
SELECT user_id, start FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start) <= 50""")
def noise_windows(spark, sf_dir):
    return temporal.quiet_windows(_events(spark, sf_dir), ["user_id"], "us", 1_000_000, 3_600_000_000, 50)


@query("""WITH x AS (SELECT event_id, user_id, value - 200 AS v FROM events), p AS (SELECT *, sum((v < 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM x),
q AS (SELECT *, sum((v > 150)::INT) OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS n FROM p) SELECT event_id FROM q WHERE v > 150 AND n = 1""")
def trigger_hysteresis(spark, sf_dir):
    return temporal.armed_triggers(_t(spark, sf_dir, "events").withColumn("v", F.col("value") - 200), ["user_id"], ["event_id"], "v", 150).select("event_id")


_BASE = f"""{_P}, b AS (SELECT *, list_sum(pulse[1:16])::DOUBLE / 16 AS m, list_sum(list_transform(pulse[1:16], lambda x: x * x))::DOUBLE / 16 AS q, list_max(pulse)::DOUBLE AS peak, list_sum(pulse[16:64])::DOUBLE / 49 AS a,
 list_sum(list_transform(pulse[16:64], lambda x: x * x))::DOUBLE / 49 AS aq FROM p), c AS (SELECT *, sqrt(greatest(q - m * m, 0)) AS rms, pulse[16] - m > 4.3 * sqrt(greatest(q - m * m, 0)) AS early FROM b)"""


@query(f"""WITH {_BASE} SELECT vec_id, round(m, 6) AS pretrig_mean, round(rms, 6) AS pretrig_rms, CASE WHEN m < peak THEN (list_position(pulse, list_max(pulse)) - 1)::INT ELSE 0 END AS peak_index,
CASE WHEN m < peak THEN peak - floor(m + 0.5) ELSE 0 END AS peak_value, list_min(pulse)::DOUBLE AS min_value, early::INT AS shift1, round(a - m, 6) AS pulse_average,
round(sqrt(greatest(aq - 2 * m * (a - m) - m * m, 0)), 5) AS pulse_rms,
round(CASE WHEN m < peak THEN ((CASE WHEN early THEN list_sum(pulse[18:23]) ELSE list_sum(pulse[19:24]) END)::DOUBLE / 6 - m) / nullif(peak - floor(m + 0.5), 0) ELSE 0 END, 6) AS promptness FROM c""")
def pulse_summary(spark, sf_dir):
    s = P.summary(F.col("pulse"), PRE)
    digits = {"pretrig_mean": 6, "pretrig_rms": 6, "pulse_average": 6, "pulse_rms": 5, "promptness": 6}
    return _pulses(spark, sf_dir).select("vec_id", *(F.round(c, digits[k]).alias(k) if k in digits else c.alias(k) for k, c in s.items()))


@query(f"""WITH {_BASE}, h AS (SELECT vec_id, pulse, peak - floor(m + 0.5) AS top, m FROM c),
k AS (SELECT *, list_filter(range(16, 64), lambda i: pulse[i + 1] > floor(0.1 * top + m))[1] AS lo, list_filter(range(16, 64), lambda i: pulse[i + 1] > floor(0.9 * top + m))[1] - 1 AS hi FROM h)
SELECT vec_id, round(CASE WHEN hi >= lo AND pulse[hi + 1] > pulse[lo + 1] THEN 0.01 * (hi - lo) * top / (pulse[hi + 1] - pulse[lo + 1]) ELSE 0.01 END, 8) AS rise_time,
round(0.1 * list_max(list_transform(range(22, 64), lambda i: least(2 * pulse[i + 1] + pulse[i] - pulse[i - 2] - 2 * pulse[i - 3], 2 * pulse[i - 1] + pulse[i - 2] - pulse[i - 4] - 2 * pulse[i - 5]))), 6)::DOUBLE AS steepest FROM k""")
def pulse_rise(spark, sf_dir):
    return _pulses(spark, sf_dir).select("vec_id", F.round(P.rise_time(F.col("pulse"), PRE, 0.01), 8).alias("rise_time"), F.round(P.steepest(F.col("pulse"), PRE), 6).cast("double").alias("steepest"))


@query(f"""WITH {_P}, u AS (SELECT label, unnest(pulse) AS x, generate_subscripts(pulse, 1) - 1 AS sample, list_sum(pulse[1:16])::DOUBLE / 16 AS m FROM p)
SELECT label, sample::INT AS sample, round(avg(x::DOUBLE) - avg(m), 6) AS level FROM u GROUP BY ALL""")
def average_pulse(spark, sf_dir):
    return pulse_stats.average_pulse(_pulses(spark, sf_dir), ["label"], "pulse", PRE).select("label", "sample", F.round("level", 6).alias("level"))


@query(f"WITH {_P} SELECT label, floor(median(list_position(pulse, list_max(pulse)) - 1))::INT AS peak_index FROM p GROUP BY label")
def typical_peak(spark, sf_dir):
    return pulse_stats.typical_peak(_pulses(spark, sf_dir), ["label"], "pulse")


@query(f"WITH {_P} SELECT vec_id, list_inner_product(pulse::DOUBLE[], {WEIGHTS}::DOUBLE[]) AS height FROM p")
def filter_one_lag(spark, sf_dir):
    return _pulses(spark, sf_dir).select("vec_id", P.one_lag(F.col("pulse"), WEIGHTS).alias("height"))


@query(f"""WITH {_P}, c AS (SELECT vec_id, {', '.join(f'list_inner_product(pulse[{k + 1}:{k + 60}]::DOUBLE[], {WEIGHTS60}::DOUBLE[]) AS c{k}' for k in range(5))} FROM p),
q AS (SELECT vec_id, {', '.join(f"({' + '.join(f'({w}) * c{k}' for k, w in enumerate(row))}) / 70.0::DOUBLE AS p{i}" for i, row in enumerate(P.PARABOLA))} FROM c)
SELECT vec_id, round(p0 - p1 * p1 / nullif(4 * p2, 0), 1) AS height, round(-p1 / nullif(2 * p2, 0), 6) AS place FROM q""")
def filter_five_lag(spark, sf_dir):
    y, x = P.five_lag(F.col("pulse"), WEIGHTS60)
    return _pulses(spark, sf_dir).select("vec_id", _rounded(y, 1).alias("height"), _rounded(x, 6).alias("place"))


@query(f"WITH {_P}, y AS (SELECT vec_id, list_inner_product(pulse::DOUBLE[], {WEIGHTS}::DOUBLE[]) AS y, list_inner_product(pulse::DOUBLE[], {ARRIVAL}::DOUBLE[]) AS t FROM p) SELECT vec_id, y AS height, round(t / nullif(y, 0), 8) AS arrival FROM y")
def filter_arrival(spark, sf_dir):
    y, t = P.height_and_arrival(F.col("pulse"), WEIGHTS, ARRIVAL)
    return _pulses(spark, sf_dir).select("vec_id", y.alias("height"), F.round(t, 8).alias("arrival"))


@query(f"""WITH {_P}, r AS (SELECT vec_id, label, (list_max(pulse) - list_min(pulse))::DOUBLE AS r FROM p), m AS (SELECT label, median(r) AS med FROM r GROUP BY label),
s AS (SELECT r.label, any_value(med) AS med, median(abs(r - med)) * 1.4826 AS smad FROM r JOIN m USING (label) GROUP BY r.label) SELECT vec_id FROM r JOIN s USING (label) WHERE r <= med + 1.0 * smad""")
def noise_excursion(spark, sf_dir):
    return pulse_stats.quiet_records(_pulses(spark, sf_dir), ["label"], "pulse", 1.0).select("vec_id")


@query(f"""WITH {_P}, y AS (SELECT vec_id, label, list_transform(pulse, lambda x: x - list_avg(pulse)) AS y FROM p),
c AS (SELECT label, k, list_inner_product(y[1:64 - k], y[k + 1:64]) / 64 AS v FROM y, range(8) t(k)) SELECT label, k::INT AS lag, round(avg(v), 3) AS value FROM c GROUP BY ALL""")
def autocorrelation(spark, sf_dir):
    return pulse_stats.autocorrelation(_pulses(spark, sf_dir), ["label"], "pulse", 8).select("label", "lag", F.round("value", 3).alias("value"))


_PSD = f"""{_P}, d AS (SELECT vec_id, label, k, list_sum(list_transform(range(64), lambda j: pulse[j + 1] * cos(2 * pi() / 64 * ((k * j) % 64)))) AS c, list_sum(list_transform(range(64), lambda j: pulse[j + 1] * sin(2 * pi() / 64 * ((k * j) % 64)))) AS s FROM p, range(33) t(k)),
f AS (SELECT label, k, k / 0.64::DOUBLE AS frequency, avg(c * c + s * s) * 0.01 / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS psd FROM d GROUP BY label, k)"""


@query(f"WITH {_PSD} SELECT label, k::INT AS k, round(frequency, 6) AS frequency, round(psd, 2) AS psd FROM f")
def power_spectrum(spark, sf_dir):
    p = pulse_stats.periodogram(_pulses(spark, sf_dir), ["label"], "pulse", N, 0.01)
    return p.select("label", "k", F.round("frequency", 6).alias("frequency"), F.round("psd", 2).alias("psd"))


@query(f"WITH {_PSD} SELECT label, floor(log10(frequency) * 5)::BIGINT AS decade_bin, round(exp(avg(ln(frequency))), 6) AS frequency, round(avg(psd), 2) AS psd FROM f WHERE k > 0 GROUP BY ALL")
def log_spectrum(spark, sf_dir):
    p = pulse_stats.log_rebinned(pulse_stats.periodogram(_pulses(spark, sf_dir), ["label"], "pulse", N, 0.01), ["label"], 5)
    return p.select("label", "decade_bin", F.round("frequency", 6).alias("frequency"), F.round("psd", 2).alias("psd"))


@query("WITH m AS (SELECT user_id, median(event_id % 97) AS o FROM events GROUP BY user_id) SELECT event_id, round(value * (1 + 0.002 * (event_id % 97 - o)), 8) AS value FROM events JOIN m USING (user_id)")
def drift_correct(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("indicator", F.col("event_id") % 97)
    offset = e.groupBy("user_id").agg(F.median("indicator").alias("offset"))
    return e.join(offset, "user_id").select("event_id", F.round(P.drift_corrected(F.col("value"), F.col("indicator"), 0.002, F.col("offset")), 8).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / (2.0 - 1e-6 * l_extendedprice - 1e-12 * l_extendedprice * l_extendedprice), 6) AS energy, round(l_extendedprice, 4) AS height FROM lineitem")
def gain_calibration(spark, sf_dir):
    energy = P.quadratic_gain_energy(F.col("l_extendedprice"), -1e-12, -1e-6, 2.0)
    back = P.quadratic_gain_height(F.col("e"), -1e-12, -1e-6, 2.0)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", energy.alias("e")).select("l_orderkey", "l_linenumber", F.round("e", 6).alias("energy"), F.round(back, 4).alias("height"))


_TRIOS = """l(e) AS (VALUES (1000.0::DOUBLE), (1400.0), (1900.0), (2600.0)), c AS (SELECT (CASE WHEN l_extendedprice = 0 THEN 0 ELSE ceil(l_extendedprice / 500.0) - 1 END)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1),
b AS (SELECT b::INT AS bin, (b + 1.0::DOUBLE) * 500.0 AS label, coalesce(n, 0)::BIGINT AS n FROM range(200) t(b) LEFT JOIN c ON c.bin = b), s AS (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS r FROM b),
h(p) AS (SELECT label FROM s WHERE n > l AND n > r ORDER BY n DESC, bin LIMIT 25)"""


@query(f"""WITH {_TRIOS}, a AS (SELECT l0.e AS e0, l1.e AS e1, h0.p AS p0, h1.p AS p1, (h1.p / l1.e - h0.p / l0.e) / (h1.p - h0.p) AS slope, h0.p / l0.e - h0.p * ((h1.p / l1.e - h0.p / l0.e) / (h1.p - h0.p)) AS gain
FROM l l0 JOIN l l1 ON l0.e < l1.e JOIN h h0 ON true JOIN h h1 ON h0.p < h1.p),
f AS (SELECT e0, p0, e1, p1, l2.e AS e2, h2.p AS p2, h2.p / (gain + slope * h2.p) - l2.e AS error FROM a JOIN l l2 ON e1 < l2.e JOIN h h2 ON p1 < h2.p
WHERE slope < 0 AND 1 + 1.0 * slope / gain > 0.25 AND abs((h2.p / (gain + slope * h2.p) - l2.e) / l2.e) < 0.5)
SELECT e0, p0, e1, p1, e2, p2, round(error, 6) AS error, (row_number() OVER (ORDER BY round(abs(error / e2), 9), e0, p0, e1, p1, e2, p2))::INT AS rank FROM f""")
def three_peak_assignments(spark, sf_dir):
    """Peaks are the 25 highest local maxima of the spectrum of all rows: as many as lines, and 21 more."""
    lines = spark.createDataFrame([(x,) for x in (1000.0, 1400.0, 1900.0, 2600.0)], "energy double")
    maxima = histograms.local_maxima(histograms.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 500.0, 200), [])
    peaks = maxima.orderBy(F.desc("n_rows"), "bin").limit(25).select(F.col("label").alias("height"))
    return pulse_stats.ranked_assignments(lines, peaks, 1.0, 0.5).withColumn("error", F.round("error", 6))


@query("""WITH h AS (SELECT DISTINCT p_size, p_retailprice AS h FROM part),
t AS (SELECT a.p_size, a.h AS h0, b.h AS h1, c.h AS h2, abs(1000.0 + (b.h - a.h) / (c.h - a.h) * 900.0 - 1300.0) AS rms FROM h a JOIN h b ON a.p_size = b.p_size AND a.h < b.h JOIN h c ON a.p_size = c.p_size AND b.h < c.h)
SELECT p_size, h0, h1, h2, round(rms, 6) AS rms FROM t QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY rms, h0, h1, h2) = 1""")
def combinatoric_assignment(spark, sf_dir):
    """Over all channels and all of their heights."""
    peaks = _t(spark, sf_dir, "part").select("p_size", F.col("p_retailprice").alias("height"))
    return pulse_stats.best_combination([1000.0, 1300.0, 1900.0], peaks, ["p_size"]).withColumn("rms", F.round("rms", 6))


@query(SQL["combinatoric_assignment"])
def combinatoric_assignment_all(spark, sf_dir):
    """The older name of combinatoric_assignment."""
    return combinatoric_assignment(spark, sf_dir)


@query("""WITH c AS (SELECT (CASE WHEN l_extendedprice = 0 THEN 0 ELSE ceil(l_extendedprice / 500.0) - 1 END)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1),
h AS (SELECT b::INT AS bin, (b + 1.0::DOUBLE) * 500.0 AS label, coalesce(n, 0)::BIGINT AS n_rows FROM range(200) t(b) LEFT JOIN c ON c.bin = b), s AS (SELECT *, lag(n_rows) OVER (ORDER BY bin) AS l, lead(n_rows) OVER (ORDER BY bin) AS r FROM h)
SELECT bin, label, n_rows FROM s WHERE n_rows > l AND n_rows > r""")
def histogram_peaks(spark, sf_dir):
    return histograms.local_maxima(histograms.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 500.0, 200), [])


@query("""WITH c AS (SELECT user_id, (CASE WHEN value = 0 THEN 0 ELSE ceil(value / 25.0) - 1 END)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL)
SELECT user_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS entropy FROM c GROUP BY user_id""")
def histogram_entropy(spark, sf_dir):
    return histograms.entropy(_t(spark, sf_dir, "events"), "value", 0.0, 25.0, 20, ["user_id"]).withColumn("entropy", F.round("entropy", 8))


@query("""WITH u AS (SELECT user_id, value AS v, (event_id % 100) - 40.0::DOUBLE AS u FROM events),
s AS (SELECT user_id, count(*)::DOUBLE AS n, sum(CASE WHEN u < 0 THEN u ELSE 0 END) AS i, sum(CASE WHEN u >= 0 THEN u ELSE 0 END) AS j, sum(CASE WHEN u < 0 THEN u * u ELSE 0 END) AS ii, sum(CASE WHEN u >= 0 THEN u * u ELSE 0 END) AS jj,
 sum(v) AS y, sum(CASE WHEN u < 0 THEN u * v ELSE 0 END) AS iy, sum(CASE WHEN u >= 0 THEN u * v ELSE 0 END) AS jy FROM u GROUP BY user_id),
a AS (SELECT *, (y * ii * jj - i * iy * jj - j * jy * ii) / nullif(n * ii * jj - i * i * jj - j * j * ii, 0) AS a FROM s)
SELECT user_id, round(a, 6) AS level, round((iy - i * a) / nullif(ii, 0), 6) AS "left", round((jy - j * a) / nullif(jj, 0), 6) AS "right" FROM a""")
def kink_fit(spark, sf_dir):
    k = pulse_stats.kink_at(_t(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 100), ["user_id"], "x", "value", 40.0)
    return k.select("user_id", *(F.round(c, 6).alias(c) for c in ("level", "left", "right")))


@query("SELECT n_nationkey, round(0.5346 * (n_regionkey + 1) + sqrt(0.2166 * (n_regionkey + 1) * (n_regionkey + 1) + (n_nationkey + 0.5) * (n_nationkey + 0.5)), 9)::DOUBLE AS fwhm FROM nation")
def voigt_width(spark, sf_dir):
    w = P.voigt_fwhm(F.col("n_nationkey") + F.lit(0.5).cast("double"), (F.col("n_regionkey") + 1).cast("double"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.round(w, 9).alias("fwhm"))


@query("SELECT n_regionkey, round(exp(-sum((n_nationkey + 1) * 0.01 * 0.5 * 0.2)), 10) AS transmission FROM nation GROUP BY n_regionkey")
def filter_stack(spark, sf_dir):
    layers = _t(spark, sf_dir, "nation").select("n_regionkey", ((F.col("n_nationkey") + 1) * 0.01).cast("double").alias("attenuation"), F.lit(0.5).cast("double").alias("density"), F.lit(0.2).cast("double").alias("thickness"))
    return pulse_stats.transmission(layers, ["n_regionkey"]).select("n_regionkey", F.round("transmission", 10).alias("transmission"))


@query(f"""WITH {_P}, s AS (SELECT *, (vec_id % 5) - 2 + (vec_id % 4) * 0.25::DOUBLE AS s FROM p)
SELECT vec_id, list_sum(list_transform(range(64), lambda k: (k + 1) * round_even(pulse[greatest(0, least(k - floor(s)::INT, 63)) + 1] * (1 - (s - floor(s))) + pulse[greatest(0, least(k - floor(s)::INT - 1, 63)) + 1] * (s - floor(s)), 0)))::DOUBLE AS moment FROM s""")
def resampled(spark, sf_dir):
    shift = (F.col("vec_id") % 5 - 2 + (F.col("vec_id") % 4) * F.lit(0.25).cast("double")).cast("double")
    moved = P.shifted(F.col("pulse"), shift)
    return _pulses(spark, sf_dir).select("vec_id", P.dot(moved, list(range(1, N + 1))).alias("moment"))


@query(f"""WITH {_P}, t AS (SELECT label, vec_id * 64 + 30 AS trigger FROM p), s AS (SELECT vec_id, unnest(pulse) AS x, vec_id * 64 + generate_subscripts(pulse, 1) - 1 AS spot FROM p)
SELECT trigger, sum(x)::BIGINT AS total, count(*)::BIGINT AS n FROM t JOIN s ON spot >= trigger - 50 AND spot < trigger + 40 GROUP BY trigger HAVING count(*) = 90""")
def records_from_stream(spark, sf_dir):
    p = _pulses(spark, sf_dir).withColumn("one", F.lit(1))
    stream = p.select("one", F.col("vec_id").alias("chunk"), (F.col("vec_id") * N).alias("start"), F.col("pulse").alias("samples"))
    cut = pulse_stats.cut_out(stream, p.select("one", (F.col("vec_id") * N + 30).alias("trigger")), ["one"], 50, 40)
    return cut.select("trigger", F.aggregate("pulse", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("pulse").cast("long").alias("n"))


@query("SELECT event_id, regexp_extract('run7_chan' || user_id || '.ljh', '_chan(\\d+)\\..*$', 1)::BIGINT AS channel FROM events")
def channel_from_path(spark, sf_dir):
    path = F.concat(F.lit("run7_chan"), F.col("user_id").cast("string"), F.lit(".ljh"))
    return _t(spark, sf_dir, "events").select("event_id", P.channel_number(path).alias("channel"))


@query()
def learned_drift(spark, sf_dir):
    from pulseloom.operators import learning

    e = _t(spark, sf_dir, "events").withColumn("indicator", F.col("event_id") % 97)
    return learning.drift_slope(e, ["event_type"], "value", "indicator")


@query()
def learned_filters(spark, sf_dir):
    from pulseloom.operators import learning

    p = _pulses(spark, sf_dir)
    return learning.optimal_filters(p, p, ["label"], "pulse", PRE)


@query()
def time_drift_gain(spark, sf_dir):
    from pulseloom.operators import learning

    return learning.time_drift(_events(spark, sf_dir), ["event_type"], "us", "value").select("event_id", "gain")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, value, i, 0::BIGINT AS k, [{'v': value, 'k': 0::BIGINT}] AS recent FROM o WHERE i = 1
 UNION ALL SELECT user_id, event_id, value, i, k, list_append(recent, {'v': value, 'k': k})[-3:] FROM (SELECT *, last + round_even((value - list_reduce(list_transform(recent, lambda s: s.v - 100.0::DOUBLE * (s.k - last)), lambda x, y: x + y) / len(recent)) / 100.0::DOUBLE, 0)::BIGINT AS k
  FROM (SELECT o.*, r.recent, r.recent[-1].k AS last FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)))
SELECT user_id, event_id, value, round(value - 100.0::DOUBLE * k, 6) AS flat FROM r""")
def unwrap_running(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return jumps.unwrap_running(e, ["user_id"], ["event_id"], "value", 100.0, "flat").withColumn("flat", F.round("flat", 6))


@query("""WITH g AS (SELECT *, CASE WHEN event_type <> 'error' THEN value % 100 END AS m FROM events),
f AS (SELECT user_id, max(value) - min(value) AS reach, coalesce(max(m) - min(m), 0) > 75 AS low, arg_min(value, event_id) AS first FROM g GROUP BY user_id)
SELECT event_id, round(CASE WHEN reach < 100 THEN value WHEN low THEN (value + 25) % 100 - (first + 25) % 100 + first ELSE value % 100 - first % 100 + first END, 6) AS flat FROM events JOIN f USING (user_id)""")
def flux_jumps(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return jumps.flux_jumps(e, ["user_id"], ["event_id"], "value", 100.0, "flat", F.col("event_type") != "error").select("event_id", F.round("flat", 6).alias("flat"))


@query("""WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT a.user_id, abs(a.value - b.value) AS d, a.n FROM x a JOIN x b ON a.user_id = b.user_id AND a.k < b.k),
r AS (SELECT user_id, d, n, row_number() OVER (PARTITION BY user_id ORDER BY d) AS k FROM d) SELECT user_id, round(d * 2.2219 * CASE WHEN n <= 9 THEN [0.399, 0.994, 0.512, 0.844, 0.611, 0.857, 0.669, 0.872][n - 1] WHEN n % 2 = 1 THEN n / (n + 1.4) ELSE n / (n + 3.8) END, 6) AS q FROM r WHERE k = (n // 2 + 1) * (n // 2) // 2""")
def q_scale(spark, sf_dir):
    from pulseloom.operators import learning

    return learning.q_scale(_t(spark, sf_dir, "events"), ["user_id"], "value").withColumn("q", F.round("q", 6))


@query()
def line_fits(spark, sf_dir):
    from pulseloom.operators import learning

    return learning.line_fits(_t(spark, sf_dir, "events"), ["event_type"], "value", 100.0, 90.0, 2.0)


@query("""WITH c AS (SELECT event_type, (CASE WHEN value = 0 THEN 0 ELSE ceil(value / 5.0) - 1 END)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL),
h AS (SELECT g.event_type, b::INT AS bin, (b + 1.0::DOUBLE) * 5.0 AS label, coalesce(n, 0)::BIGINT AS n_rows FROM (SELECT DISTINCT event_type FROM events) g CROSS JOIN range(100) t(b) LEFT JOIN c ON c.bin = b AND c.event_type = g.event_type),
s AS (SELECT *, avg(n_rows) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM h),
n AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM s WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
t AS (SELECT *, s > coalesce(l, -1) AND s >= coalesce(r, -1) AS top, CASE WHEN NOT (s > coalesce(l, -1) AND s >= coalesce(r, -1)) AND s <= coalesce(l, 1e300) AND s < coalesce(r, 1e300) THEN s END AS low FROM n),
e AS (SELECT *, last_value(low IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(low IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t),
p AS (SELECT event_type, bin, label, s - (coalesce(b, a, 0) + coalesce(a, b, 0)) / 2 AS prominence FROM e WHERE top)
SELECT event_type, bin, label, round(prominence, 6) AS prominence FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY prominence DESC, bin) <= 3""")
def prominent_peaks(spark, sf_dir):
    from pulseloom.operators import learning

    found = learning.prominent_peaks(histograms.histogram(_t(spark, sf_dir, "events"), "value", 0.0, 5.0, 100, ["event_type"]), ["event_type"], 2, 3)
    return found.withColumn("prominence", F.round("prominence", 6))


@query("""WITH k AS (SELECT event_type, min(value) AS x0, max(value) AS x1 FROM events GROUP BY event_type)
SELECT event_id, round(10.0 + (value - x0) * (30.0 - 10.0) / (x1 - x0), 6) AS energy FROM events JOIN k USING (event_type)""")
def two_point_calibration(spark, sf_dir):
    from pulseloom.operators import learning

    e = _t(spark, sf_dir, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("x0"), F.max("value").alias("x1"))
    knots = ends.select("event_type", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(10.0).alias("y")), F.struct(F.col("x1").alias("x"), F.lit(30.0).alias("y")))).alias("k")).select("event_type", "k.x", "k.y")
    return learning.spline_applied(e, learning.natural_spline(knots, ["event_type"]), ["event_type"], "value", "energy").select("event_id", F.round("energy", 6).alias("energy"))


@query("""WITH m AS (SELECT user_id, median(event_id % 97) AS o FROM events WHERE value > 50 GROUP BY user_id)
SELECT event_id, round(2 * (value * (1 + 0.002 * ((event_id % 97) - o))), 7) AS twice FROM events LEFT JOIN m USING (user_id)""")
def recipe_replay(spark, sf_dir):
    from pulseloom.plans.recipe import Recipe, Step

    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 97).alias("ind"))
    _, recipe = Recipe(("user_id",)).then(e, Step({"dc": "value * (1 + 0.002 * (ind - off))"}, ("value", "ind"), {"off": ("median", "ind")}, "value > 50"))
    _, recipe = recipe.then(recipe.replay(e), Step({"twice": "2 * dc"}, ("dc",)))
    return recipe.trimmed(["twice"]).replay(e).select("event_id", F.round("twice", 7).alias("twice"))


@query(f"""WITH {_BASE}, d AS (SELECT vec_id, label, round(m, 6) AS base, CASE WHEN m < peak THEN peak - floor(m + 0.5) ELSE 0 END AS top FROM c),
g AS (SELECT *, top / (1.1 + 0.0001 * top + 1e-9 * top * top) AS energy FROM d)
SELECT vec_id, top, round(energy, 6) AS energy, CASE WHEN energy > 150 THEN 'high' WHEN energy > 50 THEN 'middle' ELSE 'fallback' END AS class FROM g""")
def recipe_of_operations(spark, sf_dir):
    """Summary, calibration and categories, recorded as steps, trimmed to what is needed, and replayed."""
    from pulseloom.plans.recipe import Recipe, Step

    rows, recipe = _pulses(spark, sf_dir), Recipe(("label",))
    steps = [
        Step.named("summary", ["pulse"], ["base", "top"], pulse="pulse", pre=PRE, columns={"base": "pretrig_mean", "top": "peak_value"}),
        Step.named("summary", ["pulse"], ["rms"], pulse="pulse", pre=PRE, columns={"rms": "pulse_rms"}),
        Step.named("gain", ["top"], ["energy"], height="top", a=1e-9, b=0.0001, c=1.1, output="energy"),
        Step.named("categorize", ["energy"], ["class"], conditions={"middle": "energy > 50", "high": "energy > 150"}, output="class"),
    ]
    made = rows
    for step in steps:
        made, recipe = recipe.then(made, step)
    return recipe.trimmed(["class"]).replay(rows).select("vec_id", "top", F.round("energy", 6).alias("energy"), "class")


@query("SELECT event_id, round(sqrt(value) + 1, 9) AS mapped FROM events")
def column_map(spark, sf_dir):
    """A function of Python over a column, a batch at a time."""
    return mapped(_t(spark, sf_dir, "events"), "value", lambda x: x**0.5 + 1, "mapped").select("event_id", F.round("mapped", 9).alias("mapped"))


@query("SELECT user_id, event_id, value FROM events")
def partitioned_round_trip(spark, sf_dir):
    import uuid

    from pulseloom.session import shared_folder

    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    write_by_channel(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", path)
    return spark.read.schema("event_id long, value double, user_id long").parquet(path).select("user_id", "event_id", "value")


@query("""SELECT date_trunc('day', ts) AS since, event_type, (CASE WHEN value = 0 THEN 0 ELSE ceil(value / 100.0) - 1 END)::INT AS bin, count(*) AS n_rows FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL""")
def daily_spectra(spark, sf_dir):
    from pulseloom.streaming.replay import windowed_histogram

    out = windowed_histogram(_t(spark, sf_dir, "events"), "ts", "value", 0.0, 100.0, 5, "1 day", "1 hour", ("event_type",))
    return out.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("""WITH u AS (SELECT event_type, k::DOUBLE AS k, value AS y, (event_id % 100)::DOUBLE - k AS u, least((event_id % 100)::DOUBLE - k, 0) AS a, greatest((event_id % 100)::DOUBLE - k, 0) AS b FROM events, (VALUES (20), (40), (60), (80)) t(k)),
s AS (SELECT event_type, k, count(*)::DOUBLE AS n, sum(a) AS i, sum(b) AS j, sum(a * a) AS ii, sum(b * b) AS jj, sum(y) AS y, sum(a * y) AS iy, sum(b * y) AS jy FROM u GROUP BY ALL),
f AS (SELECT *, (y * ii * jj - i * iy * jj - j * jy * ii) / (n * ii * jj - i * i * jj - j * j * ii) AS level FROM s),
g AS (SELECT event_type, k, level, (iy - i * level) / ii AS l, (jy - j * level) / jj AS r FROM f),
m AS (SELECT g.event_type, g.k, level, l, r, sum((y - level - CASE WHEN u < 0 THEN l ELSE r END * u) ** 2) AS misfit FROM u JOIN g ON g.event_type = u.event_type AND g.k = u.k GROUP BY ALL)
SELECT event_type, k AS place, round(level, 6) AS level, round(l, 7) AS "left", round(r, 7) AS "right", round(misfit, 3) AS misfit FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY misfit, k) = 1""")
def kink_search(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 100)
    found = pulse_stats.kink_fit(e, ["event_type"], "x", "value", [20, 40, 60, 80])
    return found.select("event_type", "place", F.round("level", 6).alias("level"), F.round("left", 7).alias("left"), F.round("right", 7).alias("right"), F.round("misfit", 3).alias("misfit"))


@query()
def arrival_model(spark, sf_dir):
    p = _pulses(spark, sf_dir).withColumns({"promptness": P.summary(F.col("pulse"), PRE)["promptness"], "size": P.excursion(F.col("pulse")).cast("double")})
    return pulse_stats.arrival_model(p, ["label"], "pulse", PRE, "promptness", "size")


@query(f"""WITH {_P}, s AS (SELECT vec_id * 64 + generate_subscripts(pulse, 1) - 1 AS spot, unnest(pulse)::DOUBLE AS x FROM p),
y AS (SELECT spot, -x + lead(x) OVER (ORDER BY spot) AS y FROM s), q AS (SELECT *, sum((y < 0)::INT) OVER (ORDER BY spot) AS epoch FROM y WHERE y IS NOT NULL),
r AS (SELECT *, sum((y > 100)::INT) OVER (PARTITION BY epoch ORDER BY spot) AS n FROM q) SELECT 1 AS one, spot AS trigger FROM r WHERE y > 100 AND n = 1""")
def stream_triggers(spark, sf_dir):
    p = _pulses(spark, sf_dir)
    stream = p.select(F.lit(1).alias("one"), F.col("vec_id").alias("chunk"), (F.col("vec_id") * N).alias("start"), F.col("pulse").alias("samples"))
    return pulse_stats.stream_triggers(stream, ["one"], [-1.0, 1.0], 100.0)


@query()
def multi_fits(spark, sf_dir):
    from pulseloom.operators import learning

    return learning.multi_fits(_t(spark, sf_dir, "events"), ["event_type"], "value", {"low": 100.0, "mid": 220.0}, 60.0, 2.0)


@query()
def phase_shift(spark, sf_dir):
    from pulseloom.operators import learning

    e = _t(spark, sf_dir, "events").withColumn("phase", (F.col("event_id") % 101) / 101 - 0.5)
    return learning.phase_shift(e, ["event_type"], "phase", "value", [100.0, 200.0], 0.2).select("event_id", "corrected")
