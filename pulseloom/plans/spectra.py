"""Entropies, drift and noise operators as queries over events: channels are users or kinds of event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.operators import entropies as E
from pulseloom.operators import filters, learning
from pulseloom.operators import streams as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_SIZES = """v AS (SELECT {key}, {value} / {width} AS y, count(*) FILTER ({p}) AS p, count(*) FILTER ({q}) AS q FROM events GROUP BY ALL),
s AS (SELECT a.{key}, a.y, a.p, a.q, sum(CASE WHEN b.y <= a.y THEN b.p * exp(b.y - a.y) ELSE 0 END) AS fp, sum(CASE WHEN b.y <= a.y THEN b.q * exp(b.y - a.y) ELSE 0 END) AS fq,
sum(CASE WHEN b.y > a.y THEN b.p * exp(a.y - b.y) ELSE 0 END) AS rp, sum(CASE WHEN b.y > a.y THEN b.q * exp(a.y - b.y) ELSE 0 END) AS rq, min(CASE WHEN b.y > a.y THEN b.y END) - a.y AS g, min(b.y) AS first
FROM v a JOIN v b ON a.{key} = b.{key} GROUP BY a.{key}, a.y, a.p, a.q),
i AS (SELECT {key}, p, q, CASE WHEN g IS NULL THEN fp * (ln(fq) - 1) ELSE (rp * exp(g) - fp * exp(-g)) * (ln(fq * exp(-g) + rq * exp(g)) - 1) - (rp - fp) * (ln(fq + rq) - 1)
 + 2 * (rp * fq + fp * rq) * CASE WHEN fq = 0 THEN (1 - exp(-g)) / rq WHEN rq = 0 THEN (exp(g) - 1) / fq ELSE (atan(exp(g) * sqrt(rq / nullif(fq, 0))) - atan(sqrt(rq / nullif(fq, 0)))) / sqrt(nullif(fq * rq, 0)) END END
 + CASE WHEN y = first AND rp + p > 0 THEN (rp + p) * (ln(rq + q) - 1) ELSE 0 END AS t FROM s)
SELECT {key}, round(ln(2 * {width} * sum(q)) - sum(t) / (2 * sum(p)), 7) AS entropy FROM i GROUP BY {key} HAVING sum(p) > 0 AND sum(q) > 0"""


@query("WITH " + _SIZES.format(key="user_id", value="value", width=5.0, p="true", q="true"))
def exact_entropy(spark, sf_dir):
    """Entropy of each user's values blurred by two-sided exponentials, exactly."""
    return E.entropy(_events(spark, sf_dir), ["user_id"], "value", 5.0).withColumn("entropy", F.round("entropy", 7))


@query("WITH " + _SIZES.format(key="event_type", value="value", width=20.0, p="user_id % 2 = 0", q="user_id % 2 = 1"))
def exact_cross_entropy(spark, sf_dir):
    """Cross entropy of odd users' values from even users', for each kind of event."""
    e = _events(spark, sf_dir)
    return E.cross_entropy(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), ["event_type"], "value", 20.0).withColumn("entropy", F.round("entropy", 7))


_BLURRED = """c AS (SELECT {key}, floor(({x}) / 0.25::DOUBLE)::BIGINT AS k, count(*) AS n FROM {source} GROUP BY ALL),
r AS (SELECT {key}, unnest(range(min(k) - 400, max(k) + 401)) AS k FROM c GROUP BY {key}),
p AS (SELECT r.{key}, r.k, sum(n * exp(-abs(r.k - c.k) / 20.0::DOUBLE)) AS p FROM r JOIN c ON c.{key} = r.{key} AND abs(r.k - c.k) <= 400 GROUP BY ALL),
t AS (SELECT {key}, p / sum(p) OVER (PARTITION BY {key}) / 0.25 AS p FROM p WHERE p > 0)
SELECT {key}, round(-sum(p * ln(p)) * 0.25, 7) AS entropy FROM t GROUP BY {key}"""


@query(
    "WITH m AS (SELECT event_type, value, 2 * (epoch_us(ts) - min(epoch_us(ts)) OVER w)::DOUBLE / (max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) - 1 AS u FROM events WINDOW w AS (PARTITION BY event_type)), "
    + _BLURRED.format(key="event_type", x="value * (1 + 0.002 * u - 0.001 * (1.5 * u * u - 0.5))", source="m")
)
def time_drift_candidate(spark, sf_dir):
    """Entropy of each kind of event's values under one candidate drift of two Legendre terms: what a step of the search asks for."""
    e = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = e.groupBy("event_type").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    u = 2 * (F.col("us") - F.col("a")).cast("double") / (F.col("b") - F.col("a")) - 1
    drifted = e.join(span, "event_type").withColumn("x", F.col("value") * (1 + E.legendre(u, F.array(F.lit(0.002), F.lit(-0.001)))))
    return learning.laplace_entropy(drifted, ["event_type"], "x", 5.0).withColumn("entropy", F.round("entropy", 7))


@query("WITH " + _BLURRED.format(key="user_id", x="value", source="events"))
def laplace_entropy(spark, sf_dir):
    """Entropy of each user's values from binned counts."""
    return learning.laplace_entropy(_events(spark, sf_dir), ["user_id"], "value", 5.0).withColumn("entropy", F.round("entropy", 7))


@query()
def drift_slopes(spark, sf_dir):
    """Slopes of each kind of event's values against a synthetic indicator, by least entropy over all rows."""
    e = _events(spark, sf_dir).withColumn("indicator", (F.col("event_id") % 97).cast("double"))
    return E.drift_by_entropy(e, ["event_type"], "value", "indicator", sigma=2.0).select("event_type", "slope", "offset")


@query()
def time_drift_series(spark, sf_dir):
    """Legendre series of each kind of event's drift in time, by least entropy over all rows."""
    return E.time_drift_by_entropy(_events(spark, sf_dir), ["event_type"], "ts", "value", 5.0, degrees=2).select("event_type", "coefficients", "before", "after")


_STREAM = """p AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::INT + 5000) AS pulse, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk FROM embeddings),
s AS (SELECT label, chunk * 64 + generate_subscripts(pulse, 1) - 1 AS spot, unnest(pulse)::DOUBLE AS x FROM p)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors, one after the other, as the chunks of a continuous stream."""
    chunk = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("chunk", chunk.cast("long"))
    return rows.select("label", "chunk", (F.col("chunk") * 64).alias("start"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int") + 5000).alias("samples"))


@query(f"""WITH {_STREAM}, y AS (SELECT label, spot, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS y FROM s WINDOW w AS (PARTITION BY label ORDER BY spot)),
n AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS c, max(spot) OVER (PARTITION BY label) - 4 AS last FROM y WINDOW w AS (PARTITION BY label ORDER BY spot)),
e AS (SELECT label, spot, y < 0 AS arms, y > 150 AND y >= c AND y > a AS peak FROM n WHERE spot BETWEEN 1 AND last),
q AS (SELECT *, sum(arms::INT) OVER (PARTITION BY label ORDER BY spot) AS epoch FROM e)
SELECT label, spot + 1 AS trigger FROM q WHERE peak AND epoch > 0 QUALIFY row_number() OVER (PARTITION BY label, epoch ORDER BY spot) = 1""")
def peak_triggers(spark, sf_dir):
    """Peaks of the second difference of each label's stream."""
    return S.peak_triggers(_stream(spark, sf_dir), ["label"], [1.0, -2.0, 1.0], 150.0)


@query(f"""WITH {_STREAM}, m AS (SELECT label, avg(x) AS m, count(*) AS n FROM s GROUP BY label), z AS (SELECT s.label, spot, x - m AS x, n FROM s JOIN m ON m.label = s.label)
SELECT a.label, l::INT AS lag, round(sum(a.x * b.x) / any_value(a.n), 4) AS value FROM z a, range(70) r(l) JOIN z b ON b.label = a.label AND b.spot = a.spot + l GROUP BY a.label, l""")
def continuous_correlation(spark, sf_dir):
    """Correlations of each label's stream, at lags beyond the length of a chunk."""
    return S.continuous_correlation(_stream(spark, sf_dir), ["label"], 70).withColumn("value", F.round("value", 4))


@query(f"""WITH {_STREAM}, m AS (SELECT label, spot // 120 AS block, avg(x) AS m FROM s GROUP BY ALL HAVING count(*) = 120), z AS (SELECT s.label, block, spot, x - m AS x FROM s JOIN m ON m.label = s.label AND m.block = spot // 120),
k AS (SELECT label, block FROM z GROUP BY ALL HAVING max(abs(x)) <= 450), n AS (SELECT label, count(*) AS n FROM k GROUP BY label)
SELECT a.label, l::INT AS lag, round(sum(a.x * b.x) / any_value(n.n) / 120, 4) AS value FROM z a JOIN k ON k.label = a.label AND k.block = a.block JOIN n ON n.label = a.label, range(8) r(l) JOIN z b ON b.label = a.label AND b.block = a.block AND b.spot = a.spot + l GROUP BY a.label, l""")
def block_correlation(spark, sf_dir):
    """Correlations within blocks that cross chunks' borders, without blocks that stray far."""
    return S.block_correlation(_stream(spark, sf_dir), ["label"], 8, 450.0).withColumn("value", F.round("value", 4))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)
SELECT user_id, max(d) AS largest_gap, coalesce(max(d) <= 90000000000, false) AS continuous FROM g GROUP BY user_id""")
def continuity(spark, sf_dir):
    """Whether each user's events follow each other without a long gap."""
    e = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.continuity(e, ["user_id"], "event_id", "us", 90_000_000_000, slot=1000)


@query()
def filter_kinds(spark, sf_dir):
    """Filters of all kinds of each label's vectors as pulses; noise records are those of even number."""
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int") + 5000)
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", whole.alias("pulse"))
    found = filters.filter_table(p, p.where("vec_id % 2 = 0"), ["label"], "pulse", 16, filters.KINDS, decays=[20.0])
    return found.select("label", "kind", F.round("peak", 6).alias("peak"), F.round("variance", 6).alias("variance"), F.round("resolution", 6).alias("resolution"))
