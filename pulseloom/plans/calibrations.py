"""Calibration operators as queries: a channel is a line number, and heights are prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.operators import calibration as C
from pulseloom.operators import rough_calibration as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


#: Energies that stand at three quantiles of a channel's prices.
ENERGIES = {0.1: 1000.0, 0.5: 4500.0, 0.9: 9000.0}


def _anchors(lines: DataFrame, *parts: float) -> DataFrame:
    """Anchors at quantiles of each channel's prices."""
    heights = F.percentile("l_extendedprice", F.array(*map(F.lit, parts)))
    pairs = F.arrays_zip(heights.alias("height"), F.array(*[F.lit(ENERGIES[p]) for p in parts]).alias("energy"))
    return lines.groupBy("l_linenumber").agg(pairs.alias("p")).select("l_linenumber", F.inline("p").alias("height", "energy"))


_ANCHORS = "a AS (SELECT l_linenumber, unnest(quantile_cont(l_extendedprice, [{0}])) AS h, unnest([{1}]) AS e FROM lineitem GROUP BY l_linenumber)"
_TWO = _ANCHORS.format("0.1, 0.9", "1000.0::DOUBLE, 9000.0")
_THREE = _ANCHORS.format("0.1, 0.5, 0.9", "1000.0::DOUBLE, 4500.0, 9000.0")


@query(f"""WITH {_TWO}, c AS (SELECT l_linenumber, arg_min(h, e) AS h0, arg_max(h, e) AS h1, min(e) AS e0, max(e) AS e1 FROM a GROUP BY 1),
p AS (SELECT *, (ln(e1) - ln(e0)) / (ln(h1) - ln(h0)) AS m, (h1 / e1 - h0 / e0) / (h1 - h0) AS s FROM c),
r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS h, m, s, h0, e0, h0 / e0 + s * (l_extendedprice - h0) AS g FROM lineitem JOIN p USING (l_linenumber))
SELECT l_orderkey, l_linenumber, round(exp(ln(e0) + m * (ln(h) - ln(h0))), 5) AS loglog, round(exp(ln(e0) + m * (ln(h) - ln(h0))) * m / h, 8) AS loglog_slope, round(h / g, 5) AS gain, round((g - h * s) / (g * g), 8) AS gain_slope FROM r""")
def anchor_energies(spark, sf_dir):
    """Energies and slopes of all rows by curves through two anchors a channel."""
    lines = _lines(spark, sf_dir)
    fitted = C.curves(_anchors(lines, 0.1, 0.9), ["l_linenumber"], ["loglog", "gain"])
    wide = fitted.groupBy("l_linenumber").pivot("kind", ["loglog", "gain"]).agg(F.first("pieces"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_extendedprice").join(wide, "l_linenumber")
    out = ["l_orderkey", "l_linenumber"]
    for kind in ("loglog", "gain"):
        at = (F.col("l_extendedprice"), kind, F.col(kind))
        out += [F.round(C.energy_of(*at), 5).alias(f"{kind}_e"), F.round(C.slope_of(*at), 8).alias(f"{kind}_slope")]
    return rows.select(*out).withColumnsRenamed({"loglog_e": "loglog", "gain_e": "gain"})


@query(f"""WITH {_TWO}, c AS (SELECT l_linenumber, arg_min(h, e) AS h0, arg_max(h, e) AS h1, min(e) AS e0, max(e) AS e1 FROM a GROUP BY 1),
p AS (SELECT *, (ln(e1) - ln(e0)) / (ln(h1) - ln(h0)) AS m, (h1 / e1 - h0 / e0) / (h1 - h0) AS s FROM c),
r AS (SELECT l_orderkey, l_linenumber, 100.0::DOUBLE * l_quantity AS e, m, s, h0, e0, h0 / e0 - s * h0 AS z FROM lineitem JOIN p USING (l_linenumber))
SELECT l_orderkey, l_linenumber, round(exp(ln(h0) + (ln(e) - ln(e0)) / m), 4) AS loglog, round(e * z / (1 - e * s), 4) AS gain FROM r""")
def anchor_heights(spark, sf_dir):
    """Where rows of an energy (a hundred times their quantity) should lie: the same curves the other way, by bisection."""
    lines = _lines(spark, sf_dir)
    fitted = C.curves(_anchors(lines, 0.1, 0.9), ["l_linenumber"], ["loglog", "gain"])
    energies = lines.select("l_linenumber", (100.0 * F.col("l_quantity")).alias("energy")).distinct()  # each is solved once
    solved = energies.join(fitted, "l_linenumber").select("l_linenumber", "energy", "kind", F.round(C.height_of(F.col("energy")), 4).alias("at"))
    wide = solved.groupBy("l_linenumber", "energy").pivot("kind", ["loglog", "gain"]).agg(F.first("at"))
    rows = lines.select("l_orderkey", "l_linenumber", (100.0 * F.col("l_quantity")).alias("energy"))
    return rows.join(wide, ["l_linenumber", "energy"]).select("l_orderkey", "l_linenumber", "loglog", "gain")


@query(f"""WITH {_THREE}, k(kind) AS (VALUES ('linear'), ('loglog'), ('gain'), ('invgain'), ('loggain')),
o AS (SELECT l.l_linenumber, kind, l.e AS energy, l.h AS t, b.h AS h0, b.e AS e0, c.h AS h1, c.e AS e1 FROM a l JOIN a b ON b.l_linenumber = l.l_linenumber AND b.e <> l.e JOIN a c ON c.l_linenumber = l.l_linenumber AND c.e <> l.e AND c.e > b.e, k),
y AS (SELECT *, CASE kind WHEN 'linear' THEN e0 WHEN 'loglog' THEN ln(e0) WHEN 'gain' THEN h0 / e0 WHEN 'invgain' THEN e0 / h0 ELSE ln(h0 / e0) END AS y0, CASE kind WHEN 'linear' THEN e1 WHEN 'loglog' THEN ln(e1) WHEN 'gain' THEN h1 / e1 WHEN 'invgain' THEN e1 / h1 ELSE ln(h1 / e1) END AS y1,
CASE kind WHEN 'loglog' THEN (ln(t) - ln(h0)) / (ln(h1) - ln(h0)) ELSE (t - h0) / (h1 - h0) END AS u FROM o),
z AS (SELECT *, y0 + u * (y1 - y0) AS y FROM y)
SELECT l_linenumber, kind, energy, round(CASE kind WHEN 'linear' THEN y WHEN 'loglog' THEN exp(y) WHEN 'gain' THEN t / y WHEN 'invgain' THEN t * y ELSE t * exp(-y) END - energy, 6) AS error FROM z""")
def anchor_leave_one_out(spark, sf_dir):
    """What each anchor's energy would be by the curve through the two others."""
    out = C.leave_one_out(_anchors(_lines(spark, sf_dir), 0.1, 0.5, 0.9), ["l_linenumber"], ["linear", "loglog", "gain", "invgain", "loggain"])
    return out.select("l_linenumber", "kind", "energy", F.round("error", 6).alias("error"))


_FOUR = """h AS (SELECT DISTINCT p_size, p_retailprice AS h, dense_rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) - 1 AS k FROM part),
t AS (SELECT a.p_size, a.h AS h0, b.h AS h1, c.h AS h2, d.h AS h3, sqrt(((1000.0 + 900.0 * ((b.h - a.h) / (c.h - a.h)) - 1300.0) ** 2 + (1300.0 + 1300.0 * ((c.h - b.h) / (d.h - b.h)) - 1900.0) ** 2) / 2) AS rms
FROM h a JOIN h b ON a.p_size = b.p_size AND a.h < b.h JOIN h c ON a.p_size = c.p_size AND b.h < c.h JOIN h d ON a.p_size = d.p_size AND c.h < d.h WHERE {0})
SELECT p_size, h0, h1, h2, h3, round(rms, 6) AS rms FROM t QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY round(rms, 9), h0, h1, h2, h3) = 1"""


def _four(spark, sf_dir, allowed=None):
    peaks = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", F.col("p_retailprice").alias("height"))
    found = R.assign_lines(peaks, ["p_size"], [1000.0, 1300.0, 1900.0, 2600.0], allowed)
    return found.select("p_size", *[F.get("heights", F.lit(k)).alias(f"h{k}") for k in range(4)], F.round("rms", 6).alias("rms"))


@query("WITH " + _FOUR.format("true"))
def four_line_assignment(spark, sf_dir):
    """Four lines among all heights of each channel (a size of parts)."""
    return _four(spark, sf_dir)


@query("WITH " + _FOUR.format("a.k < 3 AND b.k BETWEEN 1 AND 12 AND c.k % 2 = 0 AND d.k > 8"))
def four_line_assignment_allowed(spark, sf_dir):
    """The same, where each line may have some places in the order of heights only."""
    places = range(100_000)  # more than there are heights of a size
    return _four(spark, sf_dir, [range(3), range(1, 13), places[::2], places[9:]])


@query()
def rough_calibrations(spark, sf_dir):
    """Peaks, assignment and gain of each kind of event, from all its values."""
    gain = R.rough_calibration(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value", [50.0, 100.0, 180.0, 300.0], 4.0, extra=4)
    return gain.select("event_type", F.transform("heights", lambda h: F.round(h, 6)).alias("heights"), *[F.round(c, 9).alias(c) for c in ("rms", "a", "b", "c", "zero_gain", "below")])
