"""Faulty readings in daily bars: impossible values, spikes and stuck readings, per source."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewell.operators.records import once
from tapewell.session import ensure_checkpoint_dir

#: Neighbours of a bar are those within so many calendar days, wherever blocks end.
MARGIN_DAYS = 60
#: A series is read in blocks of so many calendar days, with that margin from both neighbours, so that no task has more of one
#: source. The results don't depend on it: what concerns a source as a whole is found over all its blocks.
BLOCK_DAYS = 2048
#: Medians per source are taken over value frequencies: sizes are counted in so many steps per doubling, over 64 doublings below 1
#: and as many above, so a median is right within 0.3 % and a source has a bounded number of counts, however many bars it has.
STEPS, DOUBLINGS = 128, 64
#: Sources whose statistics are broadcast, one short row each; more are joined.
BROADCAST_SOURCES = 200_000
#: Bars of a weekday that its usual deviation needs; a weekday with fewer has none.
LEAST_OF_WEEKDAY = 20
#: With fewer bars the deviate test can reject nothing, whatever the values; the limit in scales decides alone.
LEAST_FOR_TEST = 8


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by the Cornish-Fisher expansion around the normal quantile."""
    x = NormalDist().inv_cdf(p)
    terms = (
        (x**3 + x) / 4,
        (5 * x**5 + 16 * x**3 + 3 * x) / 96,
        (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384,
    )
    return x + sum(t / df ** (i + 1) for i, t in enumerate(terms))


def critical_value(m: int, alpha: float) -> float:
    """Limit of the deviate of the most extreme of ``m`` values."""
    t = student_quantile(1 - alpha / (2 * m), m - 2)
    return (m - 1) * t / math.sqrt((m - 2 + t * t) * m)


def deviate(value: float, m: int, total: float, squares: float) -> float:
    """Studentised deviate of ``value`` among ``m`` values with this sum and sum of squares, itself among them."""
    mean = total / m
    sd = math.sqrt(max(squares / m - mean * mean, 0.0) * m / (m - 1))
    return abs(value - mean) / sd if sd > 1e-12 else 0.0


def outliers(suspects: np.ndarray, n: int, total: float, squares: float, alpha: float) -> np.ndarray:
    """Generalised extreme studentised deviate test of ``suspects`` among ``n`` values with this sum and sum of squares: a mask.

    The most extreme suspect leaves first; the last one whose deviate is beyond its limit and all before it are outliers, so
    outliers can't hide each other. Sums are updated as values leave, so a step costs O(1).
    """
    found = np.zeros(len(suspects), bool)
    order = np.argsort(suspects, kind="stable")
    left, right, number = 0, len(suspects) - 1, 0
    gone: list[int] = []
    for m in range(n, max(n - len(suspects), 2), -1):
        mean = total / m
        low, high = suspects[order[left]], suspects[order[right]]
        if mean - low > high - mean:
            pick, left = order[left], left + 1
        else:
            pick, right = order[right], right - 1
        value = float(suspects[pick])
        gone.append(pick)
        if deviate(value, m, total, squares) > critical_value(m, alpha):
            number = len(gone)
        total, squares = total - value, squares - value * value
    found[gone[:number]] = True
    return found


def extreme_deviates(values: np.ndarray, alpha: float, share: float = 0.2) -> np.ndarray:
    """The test over a whole array, with up to ``share`` of the finite values, the farthest from the median, as suspects."""
    at = np.flatnonzero(np.isfinite(values))
    found = np.zeros(len(values), bool)
    x = values[at]
    most = int(len(at) * share)
    if len(at) < LEAST_FOR_TEST or most < 1:
        return found
    far = np.argsort(-np.abs(x - np.median(x)), kind="stable")[:most]
    found[at[far[outliers(x[far], len(x), float(x.sum()), float((x * x).sum()), alpha)]]] = True
    return found


def _shifted(x: np.ndarray, steps: Sequence[int], days: np.ndarray) -> np.ndarray:
    """``x`` so many rows before (positive steps) or after, NaN where that row is further away than the margin."""
    out = np.full((len(steps), len(x)), np.nan)
    for row, k in zip(out, steps):
        if 0 < k < len(x):
            row[k:] = np.where(days[k:] - days[:-k] <= MARGIN_DAYS, x[:-k], np.nan)
        elif k < 0 and -k < len(x):
            row[:k] = np.where(days[-k:] - days[:k] <= MARGIN_DAYS, x[-k:], np.nan)
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Signed number of the step that a value falls into; 0 stands for 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.floor(np.log2(np.abs(values)) * STEPS) + STEPS * DOUBLINGS
    size = np.clip(np.where(values == 0, 0, size), 0, 2 * STEPS * DOUBLINGS)
    return np.where(np.isfinite(values), np.sign(values) * size, 0).astype(np.int32)


def step_value(step: float) -> float:
    return math.copysign(2.0 ** ((abs(step) + 0.5) / STEPS - DOUBLINGS), step) if step else 0.0


def _step_median(values: np.ndarray) -> float:
    """Middle of the step of the lower median."""
    own = np.sort(steps(values[np.isfinite(values)]))
    return step_value(float(own[(len(own) - 1) // 2])) if len(own) else math.nan


def neighbourhood(bars: np.ndarray, days: np.ndarray, repeats: int = 5) -> dict[str, np.ndarray]:
    """What the bars around each bar of a series in date order tell. ``bars`` holds open, high, low and close; NaN stands for missing.

    ``impossible``: infinite, zero or negative prices, a low above the high, an open or close outside low and high.
    ``stuck``: bars equal to the one before, from a run with at least ``repeats`` repetitions.
    ``before``, ``after``: medians of the logs of the three bars on either side; at an end the bar's own middle stands for the missing side.
    ``away``: how far the middle of the bar is from the nearer of the two. ``move``: distance from the middle of the bar before.
    ``around``: usual move of the twenty bars around, ``near``: their usual range, both as scales.
    """
    n = len(bars)
    o, h, l, c = bars.T
    with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
        warnings.simplefilter("ignore")
        impossible = np.isinf(bars).any(1) | (bars <= 0).any(1) | (l > h) | (o > h) | (c > h) | (o < l) | (c < l)
        logs = np.log(np.where((bars > 0) & np.isfinite(bars), bars, np.nan))
        middle = np.nanmedian(logs, axis=1) if n else np.empty(0)
        before, after = np.nanmedian(_shifted(middle, (1, 2, 3), days), axis=0), np.nanmedian(_shifted(middle, (-1, -2, -3), days), axis=0)
        before, after = np.where(np.isnan(before), middle, before), np.where(np.isnan(after), middle, after)
        away = np.where(np.abs(middle - before) < np.abs(middle - after), middle - before, middle - after)
        move = np.abs(middle - _shifted(middle, (1,), days)[0])
        around = 1.4826 * np.nanmedian(_shifted(move, [k for k in range(-10, 11) if k], days), axis=0)
        ranges = np.nanmax(logs, axis=1) - np.nanmin(logs, axis=1) if n else np.empty(0)
        near = 0.6 * np.nanmedian(_shifted(ranges, (-3, -2, -1, 1, 2, 3), days), axis=0)
    same = np.zeros(n, bool)
    if n > 1:
        both = ~np.isnan(bars[1:]) & ~np.isnan(bars[:-1])
        same[1:] = (both.sum(1) >= 2) & ((bars[1:] == bars[:-1]) | ~both).all(1) & (np.diff(days) <= MARGIN_DAYS)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    stuck = np.zeros(n, bool)
    for first, stop in zip(edges[::2][edges[1::2] - edges[::2] >= repeats], edges[1::2][edges[1::2] - edges[::2] >= repeats]):
        stuck[first:stop] = True
    return {"impossible": impossible, "stuck": stuck, "before": before, "after": after, "away": away, "move": move, "around": around, "near": near}


def judge(bars: np.ndarray, weekday: np.ndarray, alpha: float = 1e-4, least: float = 9.0, repeats: int = 5, days: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Flags of one series in memory, the plain form of ``faulty_bars``: the same rules with numpy (days: consecutive if not given)."""
    n = len(bars)
    of = neighbourhood(bars, np.arange(n) if days is None else days, repeats)
    with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
        warnings.simplefilter("ignore")
        season = np.zeros(n)
        for d in np.unique(weekday):
            own = of["away"][(weekday == d) & np.isfinite(of["away"])]
            if len(own) >= LEAST_OF_WEEKDAY:
                season[weekday == d] = _step_median(own)
        usual = 1.4826 * _step_median(of["move"])
        scale = np.maximum(np.fmax(np.fmax(usual, of["around"]), of["near"]), 1e-4)  # NaN where nothing is known
        logs = np.log(np.where((bars > 0) & np.isfinite(bars), bars, np.nan))
        down, up = logs - season[:, None] - of["before"][:, None], logs - season[:, None] - of["after"][:, None]
        residual = np.where(np.sign(down) == np.sign(up), np.where(np.abs(down) < np.abs(up), down, up), 0.0) / scale[:, None]
        residual = np.where(np.isnan(logs), np.nan, residual)
        field = np.argmax(np.nan_to_num(np.abs(residual)), axis=1)
        worst = residual[np.arange(n), field]
    at = np.flatnonzero(np.abs(worst) >= least)
    x = worst[np.isfinite(worst)]
    spike = np.zeros(n, bool)
    spike[at] = outliers(worst[at], len(x), float(x.sum()), float((x * x).sum()), alpha) if len(x) >= LEAST_FOR_TEST else True
    return {"impossible": of["impossible"], "spike": spike, "stuck": of["stuck"], "field": field, "deviation": worst}


def faulty_bars(rows: DataFrame, source: str, date: str, fields: Sequence[str] = ("open", "high", "low", "close"), alpha: float = 1e-4, least: float = 9.0, repeats: int = 5) -> DataFrame:
    """Rows: source, date, ``impossible``, ``spike``, ``stuck`` (booleans), ``field``, ``deviation`` of faulty bars.

    *Range and run checks:* see ``neighbourhood``. *Spikes:* logs of the prices are split into trend, weekday effect and
    residual. The trend keeps jumps: it is the nearer of the medians of the three bars before and after, so a lasting move is
    borne out on one side, and a day deviates only if it leaves both sides in the same direction. Residuals are divided by the
    largest of the source's usual daily move, the move of the surrounding days and their trading range. Suspects are at least
    ``least`` scales away; those beyond the limits of the generalised extreme studentised deviate test among all residuals of the
    source are spikes (in a source with fewer than ``LEAST_FOR_TEST`` bars every suspect). A bar without neighbours has nothing to deviate from.

    Exact copies of a row count once. Null and NaN prices are missing, not faulty; rows without a source or a
    date can't be placed and are left out. Several different rows of one day are judged one after the other, in the order of their values.
    An empty table gives no rows.

    One shuffle by source and block of days and one pass in numpy over each block; its result is checkpointed. Medians per source
    and weekday come from counts of value steps, sums per source are combined before their shuffle. The test first asks
    whether the least extreme suspect is an outlier without the others, which needs sums only and settles nearly every source; only
    suspects of sources where it isn't are put in order.
    """
    spark = rows.sparkSession
    bars = once(rows.where(F.col(source).isNotNull() & F.col(date).isNotNull()), [source, date], list(fields))
    day = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))
    block, inside = F.floor(day / BLOCK_DAYS), F.pmod(day, F.lit(BLOCK_DAYS))
    blocks = F.array(
        F.struct(block.alias("b"), F.lit(True).alias("own")),
        F.struct(F.when(inside < MARGIN_DAYS, block - 1).when(inside >= BLOCK_DAYS - MARGIN_DAYS, block + 1).alias("b"), F.lit(False).alias("own")),
    )
    prices = [f"x{i}" for i in range(len(fields))]
    placed = bars.select(
        F.col(source).alias("source"),
        day.alias("day"),
        *[F.col(f).cast("double").alias(x) for f, x in zip(fields, prices)],
        F.explode(blocks).alias("at"),
    ).where("at.b IS NOT NULL")
    kind = rows.schema[source].dataType.simpleString()
    numbers, counted = ("before", "after", "around", "near"), ("move", "away")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        day, values, own = pdf["day"].to_numpy(), pdf[prices].to_numpy(float), pdf["own"].to_numpy(bool)
        order = np.lexsort((*values.T[::-1], day))
        of = neighbourhood(values[order], day[order], repeats)
        keep = own[order]
        out = {"source": pdf["source"].to_numpy()[order][keep], "day": day[order][keep], **{x: v[order][keep] for x, v in zip(prices, values.T)}}
        out |= {k: of[k][keep] for k in ("impossible", "stuck", *numbers)}
        for k in counted:
            out |= {f"{k}_step": steps(of[k][keep]), f"has_{k}": np.isfinite(of[k][keep])}
        return pd.DataFrame(out)

    shape = f"source {kind}, day int, {', '.join(f'{x} double' for x in prices)}, impossible boolean, stuck boolean, {', '.join(f'{k} double' for k in numbers)}, {', '.join(f'{k}_step int, has_{k} boolean' for k in counted)}"
    flat = placed.select("source", "day", *prices, F.col("at.b").alias("b"), F.col("at.own").alias("own"))
    # a fixed number of partitions: coalescing by bytes would leave the work in Python to few tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    features = flat.repartition(parts, "source", "b").groupBy("source", "b").applyInPandas(one, shape)
    others = [f(k) for k in counted for f in ("has_{}".format, "{}_step".format)]
    features = features.select("source", "day", *prices, "impossible", "stuck", *[F.nanvl(k, F.lit(None).cast("double")).alias(k) for k in numbers], *others).checkpoint()

    weekday = F.pmod(F.col("day") + 3, F.lit(7))
    both = F.array(
        F.struct(F.lit(-1).alias("what"), F.col("move_step").alias("step"), F.col("has_move").alias("has")),
        F.struct(weekday.alias("what"), F.col("away_step").alias("step"), F.col("has_away").alias("has")),
    )
    frequencies = features.select("source", F.inline(both)).where("has").groupBy("source", "what", "step").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "what")
    upto = F.sum("n").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    middle = frequencies.select("source", "what", "step", "n", upto.alias("upto"), F.sum("n").over(by).alias("all"))
    middle = middle.where((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) < F.col("all")))  # the lower median
    value = F.when(F.col("step") == 0, 0.0).otherwise(F.signum("step") * F.pow(F.lit(2.0), (F.abs("step") + 0.5) / STEPS - DOUBLINGS))
    known = middle.where((F.col("what") < 0) | (F.col("all") >= LEAST_OF_WEEKDAY)).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("what", value))).alias("usually"))
    known = known.withColumnRenamed("source", "s").checkpoint()
    known = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    known = features.join(known, F.col("source") == F.col("s"), "left").drop("s")
    usually = lambda what: F.try_element_at("usually", what.cast("int"))
    known = known.withColumns({"usual": 1.4826 * usually(F.lit(-1)), "season": usually(weekday)})
    scale = F.when(F.coalesce("usual", "around", "near").isNotNull(), F.greatest("usual", "around", "near", F.lit(1e-4)))

    def residual(x: str) -> Column:
        log = F.when((F.col(x) > 0) & (F.col(x) < float("inf")), F.log(x))
        down, up = (log - F.coalesce("season", F.lit(0.0)) - F.col(side) for side in ("before", "after"))
        return F.when(F.signum(down) != F.signum(up), F.lit(0.0)).when(F.abs(down) < F.abs(up), down).otherwise(up) / scale

    away = F.array(*[F.struct(F.abs(residual(x)).alias("size"), F.lit(-i).alias("i"), residual(x).alias("r")) for i, x in enumerate(prices)])
    worst = known.select("source", "day", "impossible", "stuck", F.array_max(F.filter(away, lambda a: a["size"].isNotNull())).alias("w"))
    worst = worst.select("source", "day", "impossible", "stuck", F.element_at(F.array(*[F.lit(f) for f in fields]), F.lit(1) - F.coalesce("w.i", F.lit(0))).alias("field"), F.col("w.r").alias("deviation"))
    suspect = F.abs("deviation") >= least
    of_all = worst.groupBy("source").agg(
        F.count("deviation").alias("n"),
        F.sum("deviation").alias("total"),
        F.sum(F.col("deviation") * F.col("deviation")).alias("squares"),
        F.count_if(suspect).alias("m"),
        F.sum(F.when(suspect, F.col("deviation"))).alias("total_s"),
        F.sum(F.when(suspect, F.col("deviation") * F.col("deviation"))).alias("squares_s"),
        F.min_by("deviation", F.when(suspect, F.abs("deviation"))).alias("least"),
    ).where("m > 0")

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            whole = []
            for r in pdf.itertuples():
                m = r.n - r.m + 1  # all that aren't suspects, and the least extreme one
                others = r.total - r.total_s + r.least, r.squares - r.squares_s + r.least**2
                whole.append(r.n < LEAST_FOR_TEST or m > 2 and deviate(r.least, m, *others) > critical_value(m, alpha))
            yield pd.DataFrame({"s": pdf["source"], "n": pdf["n"], "total": pdf["total"], "squares": pdf["squares"], "whole": np.array(whole, bool)})

    sources = of_all.mapInPandas(settle, f"s {kind}, n bigint, total double, squares double, whole boolean")
    faults = worst.where(F.col("impossible") | F.col("stuck") | suspect).join(sources, F.col("source") == F.col("s"), "left").withColumn("suspect", F.coalesce(suspect, F.lit(False)))
    settled = faults.where(~F.col("suspect") | F.col("whole")).select("source", "day", "impossible", F.col("suspect").alias("spike"), "stuck", "field", "deviation")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["spike"] = outliers(pdf["deviation"].to_numpy(float), int(pdf["n"].iloc[0]), float(pdf["total"].iloc[0]), float(pdf["squares"].iloc[0]), alpha)
        return pdf[["source", "day", "impossible", "spike", "stuck", "field", "deviation"]]

    open_ = faults.where(F.col("suspect") & ~F.col("whole")).groupBy("source").applyInPandas(test, f"source {kind}, day int, impossible boolean, spike boolean, stuck boolean, field string, deviation double")
    found = settled.unionByName(open_).where(F.col("impossible") | F.col("spike") | F.col("stuck"))
    return found.select(F.col("source").alias(source), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias(date), "impossible", "spike", "stuck", "field", "deviation")
