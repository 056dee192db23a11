"""Panel least squares with fixed effects and clustered errors, as a handful of distributed aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.functions.distributions import f_upper, t_two_sided
from tapewell.operators.panel import usable_rows

#: Distinct days are one per calendar day; this many day effects travel as a local table in every round.
MOST_DAYS = 50_000


@dataclass(frozen=True)
class RegressionSpec:
    name: str
    target: str
    regressors: Sequence[str]
    entity_effects: bool = True
    time_effects: bool = True
    cluster: str = "entity"  # entity, time or twoway
    horizon: int | None = None
    description: str = ""

    @property
    def effects(self) -> str:
        return {(True, True): "twoway", (True, False): "entity", (False, True): "time"}.get((self.entity_effects, self.time_effects), "none")


@dataclass
class RegressionResult:
    spec: RegressionSpec
    coefficients: dict[str, float]
    std_errors: dict[str, float]
    t_stats: dict[str, float | None]
    p_values: dict[str, float | None]
    n_obs: int
    n_entities: int
    n_days: int
    r2: float | None
    r2_within: float | None
    f_stat: float = 0.0
    f_pvalue: float = 1.0
    rounds: int = 0
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    def rows(self) -> list[tuple]:
        """(spec, term, coefficient, std_error, t, p) per regressor."""
        return [(self.spec.name, k, self.coefficients[k], self.std_errors[k], self.t_stats[k], self.p_values[k]) for k in self.coefficients]


def demeaned(rows: DataFrame, columns: Sequence[str], effects: str, tolerance: float = 1e-10, most: int = 300) -> tuple[DataFrame, int, Callable[[], object]]:
    """``rows`` with ``columns`` freed of entity and/or day means; the number of rounds; and what to call to free the memory held.

    Two effects on an unbalanced panel: the day effects solve a linear system whose matrix is known by what it does to
    a vector (take it to the rows, subtract the entity means, add up by day). Conjugate gradients need about ten such
    steps. A step is one job over (ticker, date) only, partitioned by ticker once and kept in memory, so that entity
    means need no shuffle; nothing but vectors with one entry per calendar day passes through the driver, which
    also keeps the lineage short.
    """
    if effects == "none":
        return rows, 0, lambda: None
    keys = {"entity": "ticker", "time": "date"}
    if effects in keys:
        by = Window.partitionBy(keys[effects])
        return rows.withColumns({c: F.col(c) - F.avg(c).over(by) for c in columns}), 1, lambda: None
    held = rows.repartition("ticker").persist()
    by = Window.partitionBy("ticker")
    k = len(columns)
    names = [f"__v{i}" for i in range(k)]
    shape = "__day date, " + ", ".join(f"{n} double" for n in names)
    first = held.withColumns({n: F.col(c) - F.avg(c).over(by) for n, c in zip(names, columns)}).groupBy("date").agg(*[F.sum(n) for n in names]).limit(MOST_DAYS + 1).collect()
    if len(first) > MOST_DAYS:
        raise ValueError("more distinct dates than a calendar has")
    days = [r[0] for r in first]
    place = {d: i for i, d in enumerate(days)}
    gap = np.array([[v or 0.0 for v in r[1:]] for r in first], float).reshape(len(days), k)
    links = held.select("ticker", "date")

    def table(v: np.ndarray) -> DataFrame:
        return F.broadcast(rows.sparkSession.createDataFrame([(d, *map(float, x)) for d, x in zip(days, v)], shape))

    def applied(v: np.ndarray) -> np.ndarray:
        joined = links.join(table(v), F.col("date") == F.col("__day"))
        less = joined.withColumns({n: F.col(n) - F.avg(n).over(by) for n in names})
        out = np.zeros_like(v)
        for r in less.groupBy("date").agg(*[F.sum(n) for n in names]).collect():
            out[place[r[0]]] = r[1:]
        return out

    effect, way = np.zeros_like(gap), gap.copy()
    size = (gap * gap).sum(0)
    enough = tolerance**2 * np.maximum(size, 1e-300)
    rounds = 0
    while rounds < most and (size > enough).any():
        rounds += 1
        moved = applied(way)
        along = (way * moved).sum(0)
        step = np.where((along > 0) & (size > enough), size / np.where(along > 0, along, 1.0), 0.0)
        effect += step * way
        gap -= step * moved
        new = (gap * gap).sum(0)
        way = gap + np.where(size > 0, new / np.where(size > 0, size, 1.0), 0.0) * way
        size = new
    if (size > enough).any():
        held.unpersist()
        raise ArithmeticError(f"day effects have not converged after {most} rounds")
    joined = held.join(table(effect), F.col("date") == F.col("__day"))
    less = joined.withColumns({c: F.col(c) - F.col(n) for n, c in zip(names, columns)})
    return less.withColumns({c: F.col(c) - F.avg(c).over(by) for c in columns}).select(*rows.columns), rounds, held.unpersist


def _cross(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Matrix of sums of products of all columns, in one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), s in zip(pairs, sums):
        out[i, j] = out[j, i] = s or 0.0
    return out


def _meat(rows: DataFrame, x: Sequence[str], keys: Sequence[str]) -> tuple[np.ndarray, int]:
    scores = rows.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("__u")).alias(f"__s{i}") for i, c in enumerate(x)])
    names = [f"__s{i}" for i in range(len(x))]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = scores.agg(F.count(F.lit(1)), *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    out = np.zeros((len(x), len(x)))
    for (i, j), s in zip(pairs, sums[1:]):
        out[i, j] = out[j, i] = s or 0.0
    return out, int(sums[0])


def run_panel_regression(panel: DataFrame, spec: RegressionSpec) -> RegressionResult:
    """Fit one specification on ``panel`` (ticker, date and the named columns).

    Rows with a missing or infinite value in any used column leave first. Errors are clustered with the factor
    G/(G-1) * (N-1)/(N-k); k counts regressors and the effects that aren't nested in the clusters; p-values are of t
    with G-1 degrees of freedom (the smaller G for two-way clusters).
    """
    missing = [c for c in (spec.target, *spec.regressors) if c not in panel.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    x, y = list(spec.regressors), spec.target
    rows = usable_rows(panel.select("ticker", "date", y, *x), [y, *x]).withColumn("date", F.col("date").cast("date"))
    if spec.effects == "none":
        rows, x = rows.withColumn("__one", F.lit(1.0)), ["__one", *x]
    raw = rows.agg(F.count(F.lit(1)), F.countDistinct("ticker"), F.countDistinct("date"), F.var_pop(y)).first()
    n, entities, days, variance = int(raw[0]), int(raw[1]), int(raw[2]), raw[3]
    if n <= len(x):
        raise ValueError(f"{spec.name}: {n} complete rows for {len(x)} regressors")
    free, rounds, release = demeaned(rows, [y, *[c for c in x if c != "__one"]], spec.effects)
    free = free.persist()
    cross = _cross(free, [*x, y])
    xx, xy, yy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    bread = np.linalg.pinv(xx)
    beta = bread @ xy
    fitted = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x)), F.lit(0.0))
    with_u = free.withColumn("__u", F.col(y) - fitted)
    rss = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    k = len(x)
    if spec.effects in ("entity", "twoway") and spec.cluster != "entity":
        k += entities - 1
    if spec.effects in ("time", "twoway") and spec.cluster != "time":
        k += days - 1

    def covariance(keys: Sequence[str]) -> tuple[np.ndarray, int]:
        meat, g = _meat(with_u, x, keys)
        return bread @ meat @ bread * (g / (g - 1) if g > 1 else 1.0) * ((n - 1) / max(1, n - k)), g

    if spec.cluster == "twoway":
        (a, ga), (b, gb), (c, _) = covariance(["ticker"]), covariance(["date"]), covariance(["ticker", "date"])
        cov, g = a + b - c, min(ga, gb)
    else:
        cov, g = covariance(["ticker" if spec.cluster == "entity" else "date"])
    free.unpersist()
    release()
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    names = [c for c in x if c != "__one"]
    at = [x.index(c) for c in names]
    t = {c: (float(beta[i] / se[i]) if se[i] > 0 else None) for c, i in zip(names, at)}
    r2w = 1 - rss / yy if yy > 0 else None
    if spec.effects == "none":
        r2 = r2w = 1 - rss / (n * variance) if variance else None
    else:
        r2 = 1 - rss / (n * variance) if variance else None
    sub = cov[np.ix_(at, at)]
    f = float(beta[at] @ np.linalg.pinv(sub) @ beta[at] / len(at)) if at else 0.0
    return RegressionResult(
        spec=spec,
        coefficients={c: float(beta[i]) for c, i in zip(names, at)},
        std_errors={c: float(se[i]) for c, i in zip(names, at)},
        t_stats=t,
        p_values={c: t_two_sided(v, g - 1) for c, v in t.items()},
        n_obs=n,
        n_entities=entities,
        n_days=days,
        r2=r2,
        r2_within=r2w,
        f_stat=f if math.isfinite(f) else 0.0,
        f_pvalue=f_upper(f, len(at), g - 1) if at and g > 1 and math.isfinite(f) else 1.0,
        rounds=rounds,
    )


def _tail(measure: str) -> str:
    return "" if measure == "ja_gk" else f"_{measure}"


def baseline_spec(h: int, split: bool = True, measure: str = "ja_gk", cluster: str = "entity", entity: bool = True, time: bool = True) -> RegressionSpec:
    """Log volatility over h days on lagged attention, sentiment, their products, validity and variance."""
    signs = ("pos_", "neg_") if split else ("",)
    x = [f"attention_std_lag{h}", *[f"sentiment_{s}std_lag{h}" for s in signs], *[f"sentiment_{s}x_attention_lag{h}" for s in signs], f"valid_sentiment_lag{h}", f"log_variance_{measure}_lag{h}"]
    return RegressionSpec(f"volatility_h{h}{_tail(measure)}", f"log_volatility_{h}d{_tail(measure)}", x, entity, time, cluster, h, f"volatility ({measure}), {h} trading days")


def extension_spec(h: int, cluster: str = "entity", entity: bool = True, time: bool = True) -> RegressionSpec:
    base = baseline_spec(h, False, "ja_gk", cluster, entity, time)
    x = [*base.regressors, f"sentiment_intensity_std_lag{h}", f"sentiment_disp_std_lag{h}"]
    return RegressionSpec(f"volatility_ext_h{h}", base.target, x, entity, time, cluster, h, f"volatility with magnitude and dispersion, {h} trading days")
