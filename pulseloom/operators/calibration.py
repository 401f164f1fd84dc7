"""Energy calibration curves through anchors: known energies whose pulse heights a channel has measured.

An anchors table has one row a channel and anchor: name, height, energy, height_err, energy_err.  `curves` turns it into
one row a channel and kind of curve; its cubic pieces travel as arrays, and heights, energies, slopes and uncertainties are
Column expressions over them, so records are calibrated in the JVM after one join on the channel.

A curve is a natural cubic spline in the plane of its kind, and goes on as a straight line there on both sides:

    linear, linear_plus_zero   energy over height; the latter has one more anchor near zero
    loglog                     log energy over log height
    gain, invgain, loggain     height / energy, energy / height, log(height / energy) over height

It passes through the anchors, or with approximate=True near them, as their uncertainties and the data's own likelihood
allow (Gaussian-process regression whose mean is a natural spline); only then has it uncertainties.

A channel has some tens of anchors at most; each fit is a small linear system in the task that has the channel's row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("linear", "linear_plus_zero", "loglog", "gain", "invgain", "loggain")
#: Steps of a bisection: enough for a double's 53 bits.
HALVINGS = 60
#: An inverse looks for heights up to 2 ** DOUBLINGS times the highest anchor.
DOUBLINGS = 8
#: What anchors' uncertainties are where they aren't given, as parts of height and energy; and of anchors added alone, in energy.
RELATIVE_ERROR, ADDED_ERROR = 1e-3, 0.01
#: Where the anchor near zero lies, as a part of the lowest; up to which part of the highest a curve should rise, and at how many points that is tested.
NEAR_ZERO, RISES_TO, TESTED = 1e-3, 1.05, 1001

_PIECE = "struct<x: double, y: double, slope: double, bend: double, twist: double, x_next: double>"
_ERROR = "struct<x: double, width: double, c: array<double>, x_next: double>"
CURVE = f"top: double, bottom: double, pieces: array<{_PIECE}>, errors: array<{_ERROR}>, problem: string"


def anchors_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, name, height, energy, height_err, energy_err: missing names are empty, missing errors a thousandth; rows without height or energy are left out."""
    have = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    h, e = F.col("height").cast("double"), F.col("energy").cast("double")
    rows = df.select(*by, have("name", F.lit("")).alias("name"), h.alias("height"), e.alias("energy"), have("height_err", RELATIVE_ERROR * h).cast("double").alias("height_err"), have("energy_err", RELATIVE_ERROR * e).cast("double").alias("energy_err"))
    return rows.where("height is not null and energy is not null")


def without_anchors(anchors: DataFrame, names: Sequence[str] = (), prefix: str | None = None, energy: float | None = None, within: float = 0.0) -> DataFrame:
    """Anchors but those of some names, of names that begin so, or of energies closer than `within` to one."""
    gone = F.col("name").isin(list(names))
    if prefix is not None:
        gone |= F.col("name").startswith(prefix)
    if energy is not None:
        gone |= F.abs(F.col("energy") - energy) < within
    return anchors.where(~gone)


def with_anchors(anchors: DataFrame, new: DataFrame, by: Sequence[str], replace: bool = True) -> DataFrame:
    """Anchors with others added; a new one takes the place of that of its name or, failing that, of the nearest energy within its energy_err.

    new: as anchors; without errors of its own it has a thousandth of its height, and ADDED_ERROR in energy.
    replace=False: an error if any would be replaced.
    """
    errors = {c: F.lit(None).cast("double") for c in ("height_err", "energy_err") if c not in new.columns}
    ready = anchors_table(new.withColumns(errors).withColumn("energy_err", F.coalesce("energy_err", F.lit(ADDED_ERROR))), by)
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    pairs = anchors.alias("a").join(ready.alias("b"), on("a", "b"))  # a channel's few anchors each
    named = (F.col("b.name") != "") & (F.col("a.name") == F.col("b.name"))
    off = F.abs(F.col("a.energy") - F.col("b.energy"))
    by_name = F.max(named).over(_each("b", by))
    nearest = F.min(F.struct(off, F.col("a.energy"), F.col("a.name"))).over(_each("b", by))
    hit = F.when(by_name, named).otherwise((off <= F.col("b.energy_err")) & (F.struct(off, F.col("a.energy"), F.col("a.name")) == nearest))
    hits = pairs.withColumn("_hit", hit).where("_hit").select(*[F.col(f"a.{c}").alias(c) for c in anchors.columns])
    if not replace and (found := hits.first()):
        raise ValueError(f"the anchor {found['name']!r} at {found['energy']} is already there")
    left = anchors.alias("a").join(hits.alias("h"), [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in anchors.columns], "left_anti")
    return left.unionByName(ready)


def _each(side: str, by: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*[F.col(f"{side}.{c}") for c in [*by, "name", "height", "energy"]])


def _plane(kind: str, h: np.ndarray, e: np.ndarray, dh: np.ndarray, de: np.ndarray, power: float) -> tuple[np.ndarray, ...]:
    """Anchors in the plane of a kind: x, y and their errors."""
    if kind == "loglog":
        x, y = np.log(h), np.log(e)
        if len(x) == 1:  # a power law through one anchor
            x, y, dh, de, h, e = np.append(x, x + 1), np.append(y, y + 1 / power), *(np.repeat(v, 2) for v in (dh, de, h, e))
        return x, y, dh / h, de / e
    if kind in ("linear", "linear_plus_zero"):
        if kind == "linear_plus_zero" and 0.0 not in h:
            low, least = h.min() * NEAR_ZERO, e.min() * NEAR_ZERO
            h, e, dh, de = np.append(low, h), np.append(least, e), np.append(low * NEAR_ZERO, dh), np.append(least * NEAR_ZERO, de)
        return h, e, dh, de
    y = {"gain": lambda: h / e, "invgain": lambda: e / h, "loggain": lambda: np.log(h / e)}[kind]()
    slope = np.polyfit(h, y, 1)[0] if len(h) > 1 else 0.0
    tilt = {"gain": slope * e - 1, "invgain": slope * h / y + 1, "loggain": slope * h - 1}[kind]
    return h, y, dh, y * np.sqrt((tilt * dh / h) ** 2 + (de / e) ** 2)


def _bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of a natural spline."""
    out, h = np.zeros(len(x)), np.diff(x)
    if len(x) > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        out[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))
    return out


def _pieces(x: np.ndarray, y: np.ndarray) -> list[dict]:
    m, h, s = _bends(x, y), np.diff(x), np.diff(y) / np.diff(x)
    slope = s - h * (2 * m[:-1] + m[1:]) / 6
    end = s[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
    rows = [(x[0], y[0], slope[0], 0.0, 0.0, x[0]), *((x[k], y[k], slope[k], m[k] / 2, (m[k + 1] - m[k]) / (6 * h[k]), x[k + 1]) for k in range(len(h))), (x[-1], y[-1], end, 0.0, 0.0, np.inf)]
    return [dict(zip(("x", "y", "slope", "bend", "twist", "x_next"), map(float, r), strict=True)) for r in rows]


class _Process:
    """Regression on a line plus an integrated Brownian slope of variance sigma ** 2; its mean is a natural spline."""

    def __init__(self, x: np.ndarray, y: np.ndarray, err: np.ndarray, sigma: float | None = None):
        self.x, self.y, self.noise = x, y, np.diag(err**2)
        self.base = np.stack([np.ones_like(x), x], 1)
        self.cov = self.kernel(x[:, None], x[None, :])
        if sigma is None:
            guess = np.log(abs(np.median(err / y)) or 1e-12)
            sigma = np.exp(_least(lambda s: -self.likelihood(np.exp(s)), guess - np.log(1e4), guess + np.log(1e4)))
        self.sigma = sigma
        total = sigma**2 * self.cov + self.noise
        self.solve = np.linalg.inv(total)
        self.line = np.linalg.inv(self.base.T @ self.solve @ self.base)
        beta = self.line @ self.base.T @ self.solve @ y
        self.fitted = self.base @ beta + sigma**2 * self.cov @ self.solve @ (y - self.base @ beta)

    @staticmethod
    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.minimum(a, b)
        return low**3 / 3 + low**2 / 2 * np.abs(a - b)

    def likelihood(self, sigma: float) -> float:
        """Log likelihood of the data, with the line's coefficients integrated out."""
        total = sigma**2 * self.cov + self.noise
        sign, size = np.linalg.slogdet(total)
        if sign <= 0:
            return -np.inf
        inner = np.linalg.solve(total, np.column_stack([self.base, self.y]))
        a = self.base.T @ inner[:, :2]
        off = self.base.T @ inner[:, 2]
        return -0.5 * (size + np.linalg.slogdet(a)[1] + self.y @ inner[:, 2] - off @ np.linalg.solve(a, off))

    def variance(self, t: np.ndarray) -> np.ndarray:
        k = self.sigma**2 * self.kernel(t[:, None], self.x[None, :])
        rest = np.stack([np.ones_like(t), t], 1) - k @ self.solve @ self.base
        return self.sigma**2 * self.kernel(t, t) - np.einsum("ij,jk,ik->i", k, self.solve, k) + np.einsum("ij,jk,ik->i", rest, self.line, rest)

    def errors(self) -> list[dict]:
        """The variance as a polynomial of degree six between neighbouring knots, exactly, in (t - x) / width."""
        x, out = self.x, []
        span = x[-1] - x[0]
        for low, high, stop in [(x[0] - span, x[0], x[0]), *zip(x[:-1], x[1:], x[1:], strict=True), (x[-1], x[-1] + span, np.inf)]:
            u = 0.5 - 0.5 * np.cos(np.pi * np.arange(7) / 6)
            c = np.linalg.solve(np.vander(u, 7, increasing=True), self.variance(low + u * (high - low)))
            out.append({"x": float(low), "width": float(high - low), "c": c.tolist(), "x_next": float(stop)})
        return out


def _least(f: Callable[[float], float], low: float, high: float) -> float:
    """Where f is least: the best of a grid, then golden sections about it."""
    grid = np.linspace(low, high, 41)
    k = int(np.argmin([f(g) for g in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, 40)]
    g = (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > 1e-9:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def _fit(kind: str, h: np.ndarray, e: np.ndarray, dh: np.ndarray, de: np.ndarray, approximate: bool, power: float) -> dict:
    order = np.argsort(e, kind="stable")
    h, e, dh, de = (v[order] for v in (h, e, dh, de))
    if len(h) == 0 or approximate and len(h) < 3:
        return {"problem": f"too few anchors: {len(h)}"}
    if (np.diff(h) <= 0).any() or (np.diff(e) <= 0).any():
        return {"problem": "heights don't rise with energies"}
    if kind != "linear" and kind != "linear_plus_zero" and (h <= 0).any() or (e <= 0).any():
        return {"problem": "heights and energies must be positive"}
    mend = lambda v: np.where(v < 0, max(0.0, v.min()), v)
    x, y, dx, dy = _plane(kind, h, e, mend(dh), mend(de), power)
    out = {"top": float(h[-1]), "bottom": float(h[0]), "problem": None, "errors": None}
    if approximate:
        slope = np.polyval(np.polyder(np.polyfit(x, y, 2)), x)
        process = _Process(x, y, np.sqrt((dx * slope) ** 2 + dy**2))
        y, out["errors"] = process.fitted, process.errors()
    elif len(x) == 1:
        x, y = x * np.array([1, 2]), y * np.array([1, 2])
    return out | {"pieces": _pieces(x, y)}


def _fitted(rows: DataFrame, keep: Sequence[str], approximate: bool, power: float) -> DataFrame:
    """keep and the curve's columns for rows of keep, kind and _a, an array of anchors."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(CURVE)
    schema = StructType([rows.schema[c] for c in keep] + kind.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(kind)
        for batch in batches:
            curves = []
            for name, a in zip(batch.column("kind").to_pylist(), batch.column("_a").to_pylist(), strict=True):
                cols = [np.array([x[k] for x in a], float) for k in ("height", "energy", "height_err", "energy_err")]
                curves.append({f: None for f in shape.names} | _fit(name, *cols, approximate, power))
            made = pa.Table.from_pylist(curves, shape).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(made.column(c).combine_chunks() if made.num_rows else pa.array([], shape.field(c).type) for c in shape.names)], [*keep, *shape.names])

    return rows.select(*keep, "_a").mapInArrow(run, schema)


def _gathered(anchors: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"no such curves: {sorted(unknown)}")
    each = F.array_sort(F.collect_list(F.struct("energy", "height", "height_err", "energy_err", "name")))
    return anchors_table(anchors, by).groupBy(*by).agg(each.alias("_a")).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))


def curves(anchors: DataFrame, by: Sequence[str], kinds: Sequence[str] = ("loglog",), approximate: bool = False, power: float = 1.15) -> DataFrame:
    """by, kind and the curve of every channel and kind.

    Channels whose anchors can't be joined (heights that don't rise with energies, too few for an approximating curve) have
    a null curve, so null energies, and the reason in `problem`.  power: of a loglog curve through one anchor.
    """
    return _fitted(_gathered(anchors, by, kinds), [*by, "kind"], approximate, power)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _piece(pieces: Column, x: Column) -> Column:
    return F.coalesce(F.get(F.filter(pieces, lambda p: x <= p["x_next"]), F.lit(0)), F.element_at(pieces, -1))


def _by_kind(kind: Column | str, ways: dict[str, Column]) -> Column:
    if isinstance(kind, str):
        return next(way for names, way in ways.items() if kind in names.split())
    out = F
    for names, way in ways.items():
        out = out.when(kind.isin(names.split()), way)
    return out


def _x(kind: Column | str, height: Column) -> Column:
    log = F.when(height > 0, F.log(height))
    if isinstance(kind, str):
        return log if kind == "loglog" else height
    return F.when(kind == "loglog", log).otherwise(height)


def _value(p: Column, u: Column) -> Column:
    return p["y"] + u * (p["slope"] + u * (p["bend"] + u * p["twist"]))


def _out(kind: Column | str, h: Column, y: Column) -> Column:
    return _by_kind(kind, {"linear linear_plus_zero": y, "loglog": F.exp(y), "gain": F.try_divide(h, y), "invgain": h * y, "loggain": h * F.exp(-y)})


def _columns(**given: Column | str | None) -> list[Column | str]:
    return [F.col(name) if c is None else c for name, c in given.items()]


def energy_of(height: Column, kind: Column | str | None = None, pieces: Column | None = None) -> Column:
    """Energy at a height; null without a curve, and for a loglog curve at heights that aren't positive.

    kind: a column, or the name of one kind, which makes for a smaller expression.
    """
    kind, pieces = _columns(kind=kind, pieces=pieces)
    h = height.cast("double")
    x = _x(kind, h)
    return _let(_piece(pieces, x), lambda p: _let(_value(p, x - p["x"]), lambda y: _out(kind, h, y)))


def slope_of(height: Column, kind: Column | str | None = None, pieces: Column | None = None) -> Column:
    """Change of energy with height."""
    kind, pieces = _columns(kind=kind, pieces=pieces)
    h = height.cast("double")
    x = _x(kind, h)

    def at(p: Column) -> Column:
        u = x - p["x"]
        return F.struct(_value(p, u).alias("y"), (p["slope"] + u * (2 * p["bend"] + 3 * u * p["twist"])).alias("s"))

    def out(q: Column) -> Column:
        y, s = q["y"], q["s"]
        return _by_kind(kind, {"linear linear_plus_zero": s, "loglog": F.exp(y) * F.try_divide(s, h), "gain": F.try_divide(y - h * s, y * y), "invgain": y + h * s, "loggain": F.exp(-y) * (1 - h * s)})

    return _let(_piece(pieces, x), lambda p: _let(at(p), out))


def height_of(energy: Column, kind: Column | str | None = None, pieces: Column | None = None, top: Column | None = None, bottom: Column | None = None) -> Column:
    """The height that has an energy, by bisection; null beyond 2 ** DOUBLINGS times the highest anchor, and for energies below the curve's at no height.

    The search is between two heights that bracket the energy: neighbouring anchors, or beyond them down to zero or up by
    doubling, so on a curve that turns it finds a height next to the anchors first.
    """
    kind, pieces, top, bottom = _columns(kind=kind, pieces=pieces, top=top, bottom=bottom)
    e = energy.cast("double")
    log = F.lit(kind == "loglog") if isinstance(kind, str) else kind == "loglog"
    # heights at 0 (or nearly), at every anchor, and at doublings of the highest; a piece of the curve lies between any two
    least = F.when(log, bottom * 2.0**-30).otherwise(F.lit(0.0))
    knots = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.when(log, F.exp(p["x"])).otherwise(p["x"]))
    places = F.concat(F.array(least), knots, F.transform(F.sequence(F.lit(1), F.lit(DOUBLINGS)), lambda k: top * F.pow(F.lit(2.0), k.cast("double"))))
    energy_on = lambda p, h: _out(kind, h, _value(p, _x(kind, h) - p["x"]))

    def spans(at: Column) -> Column:
        piece = lambda i: F.get(pieces, F.least(i, F.size(pieces) - 1))
        each = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.struct(F.get(at, i).alias("a"), F.get(at, i + 1).alias("b"), piece(i).alias("p")))
        return F.get(F.filter(each, lambda s: (energy_on(s["p"], s["a"]) <= e) & (e <= energy_on(s["p"], s["b"]))), F.lit(0))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        low = energy_on(s["p"], mid) < e
        return F.struct(F.when(low, mid).otherwise(s["a"]).alias("a"), F.when(low, s["b"]).otherwise(mid).alias("b"), s["p"].alias("p"))

    solve = lambda span: F.when(span.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), span, halve, lambda s: (s["a"] + s["b"]) / 2))
    return F.when(pieces.isNotNull(), _let(_let(places, spans), solve))


def uncertainty_of(height: Column, kind: Column | str | None = None, pieces: Column | None = None, errors: Column | None = None) -> Column:
    """The curve's own uncertainty in energy at a height; zero for curves through their anchors."""
    kind, pieces, errors = _columns(kind=kind, pieces=pieces, errors=errors)
    h = height.cast("double")
    x = _x(kind, h)
    variance = _let(_piece(errors, x), lambda p: F.aggregate(F.reverse(p["c"]), F.lit(0.0), lambda s, c: s * ((x - p["x"]) / p["width"]) + c))
    sigma = F.sqrt(F.greatest(variance, F.lit(0.0)))
    e = energy_of(h, kind, pieces)
    scale = _by_kind(kind, {"linear linear_plus_zero": F.lit(1.0), "loglog loggain": e, "gain": F.try_divide(e * e, h), "invgain": h})
    return F.when(pieces.isNull(), None).when(errors.isNull(), 0.0).otherwise(sigma * F.abs(scale))


def rises(kind: Column | str | None = None, pieces: Column | None = None, top: Column | None = None) -> Column:
    """Whether energies rise all the way from no height to somewhat above the highest anchor."""
    kind, pieces, top = _columns(kind=kind, pieces=pieces, top=top)
    log = F.lit(kind == "loglog") if isinstance(kind, str) else kind == "loglog"
    places = F.sequence(F.when(log, 1).otherwise(0), F.lit(TESTED - 1))
    steps = lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.coalesce(b > a, F.lit(False)))
    return _let(F.transform(places, lambda k: energy_of(k * (RISES_TO / (TESTED - 1)) * top, kind, pieces)), lambda e: F.forall(steps(e), lambda up: up))


def calibrated(df: DataFrame, fitted: DataFrame, by: Sequence[str], height: str, output: str = "energy") -> DataFrame:
    """df with the energy of each height by its channel's curve, for curves of one kind; channels without one have nulls."""
    name = f"_{output}_curve"
    curve = fitted.select(*by, F.struct("kind", "pieces").alias(name))
    if name in df.columns:
        raise ValueError(f"{name} is taken")
    joined = df.join(curve, list(by), "left")
    return joined.withColumn(output, energy_of(F.col(height), F.col(name)["kind"], F.col(name)["pieces"])).drop(name)


def leave_one_out(anchors: DataFrame, by: Sequence[str], kinds: Sequence[str] = ("loglog",), approximate: bool = False, power: float = 1.15) -> DataFrame:
    """by, kind, name, energy, error: for every anchor, what the curve through the others gives at its height, less its energy.

    All refits of all channels are rows of one job.
    """
    each = _gathered(anchors, by, kinds).select(*by, "kind", F.posexplode("_a").alias("_i", "_left"), F.col("_a").alias("_all"))
    rows = each.withColumn("_a", F.filter("_all", lambda a, i: i != F.col("_i"))).select(*by, "kind", F.col("_left.name").alias("name"), F.col("_left.energy").alias("energy"), F.col("_left.height").alias("_height"), "_a")
    refitted = _fitted(rows, [*by, "kind", "name", "energy", "_height"], approximate, power)
    return refitted.select(*by, "kind", "name", "energy", (energy_of(F.col("_height")) - F.col("energy")).alias("error"))
