"""Doses of listed components by constrained sampling: lists are in falling order and add up to 100 %.

Draws depend only on a list's kinds of entries and the caps that can bind, so each such pattern is drawn once, whatever the number of items that have it: the work
spreads over patterns, and a lost task repeats exactly. Draws before they are scaled depend on numbers of entries only, and the others' caps only choose among rows: both are kept
for the next pattern, so that a pattern costs a few comparisons of rows.
Main components have at least the trace line each, so lists with more than MAX_MAIN of them contradict 100 %; they are told by a
count and never gathered into a group. Contradicting constraints give a row with a reason, never a loosened one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import dose, rules
from evidentia.storage import materialize

#: The trace line, priors of water, rounds of draws, and the calibrated settings.
TRACE_LINE, WATER_LEAVE_ON, WATER_RINSE_OFF, MAX_ROUNDS = 0.1, (50.0, 95.0), (40.0, 90.0), 20
MAX_MAIN = round(100 / TRACE_LINE)
CALIBRATED = {"alpha": 0.44, "floor": 0.15, "water_leave_on": (30.0, 95.0), "n_samples": 10_000, "seed": 42}
WATER = ["WATER", "AQUA"]


class Contradiction(ValueError):
    pass


@dataclass
class Listed:
    """A list in falling order: which entries are traces or water, and their caps (nan: none)."""

    trace: np.ndarray
    water: np.ndarray
    cap: np.ndarray

    def check(self, low: float, high: float, floor: float) -> None:
        main = ~self.trace
        other = main & ~self.water
        caps = np.where(np.isnan(self.cap), np.inf, self.cap)
        if not main.any():
            raise Contradiction("no main components")
        if self.water.sum() > 1:
            raise Contradiction("more than one water")
        if not other.any():
            raise Contradiction("main components are all water")
        if (caps[main] < TRACE_LINE).any():
            raise Contradiction("a main component is capped below the trace line")
        wet = main & self.water
        if wet.any() and min(high, caps[wet][0]) < low:
            raise Contradiction("water is capped below its prior")
        if floor < 0 or other.sum() * floor > 100 - (low if wet.any() else 0):
            raise Contradiction("the floor leaves no room")
        if (caps[other] < floor).any():
            raise Contradiction("a component is capped below the floor")
        # in a falling list no component exceeds the cap of one before it, so the least cap so far holds for all that follow
        most = np.minimum.accumulate(np.where(wet, np.minimum(caps, high), np.minimum(caps, 100.0))[main])
        if most.sum() + np.minimum(caps[self.trace], TRACE_LINE).sum() < 100:
            raise Contradiction("caps add up to less than 100")


def _shares(rng: np.random.Generator, n: int, size: int, alpha: float, decay: float | None) -> np.ndarray:
    if decay is None:
        return rng.dirichlet(np.full(n, alpha), size)
    gammas = rng.standard_gamma(alpha * decay ** np.arange(n), (size, n))
    # with small shapes all may be 0; the first then takes all
    total = gammas.sum(axis=1, keepdims=True)
    gammas[total[:, 0] == 0, 0] = 1.0
    return gammas / np.where(total == 0, 1.0, total)


#: Tasks that patterns are dealt over.
DRAWING_TASKS = 96
#: Draws and rows of so many kinds are kept by a worker, of lists with at most so many entries.
KINDS_KEPT, KEPT_ENTRIES = 2, 16


class _Kept:
    """What an iterator gives, kept as far as it has been asked for."""

    def __init__(self, blocks: Iterator):
        self.blocks, self.seen = blocks, []

    def __iter__(self) -> Iterator:
        at = 0
        while True:
            if at == len(self.seen):
                block = next(self.blocks, None)
                if block is None:
                    return
                self.seen.append(block)
            yield self.seen[at]
            at += 1


def _new_draws(n_trace: int, wet: bool, n_other: int, n_samples: int, seed: int, alpha: float, decay: float | None) -> Iterator[tuple]:
    """All draws of a list with so many entries, in blocks, not scaled: traces and water in 0 to 1, shares in falling order; a column a draw."""
    rng, left = np.random.default_rng(seed), n_samples * MAX_ROUNDS
    while left:
        size = min(max(2 * n_samples, 256), left)
        left -= size
        traces = rng.random((size, n_trace)).T
        water = rng.random((1, size)) if wet else np.zeros((0, size))
        shares = -np.sort(-_shares(rng, n_other, size, alpha, decay), axis=1)
        yield traces, water, np.ascontiguousarray(shares.T)


def _new_rows(caps: tuple[float, ...], water: tuple[float, float] | None, n_other: int, floor: float, *args) -> Iterator[np.ndarray]:
    """The draws, scaled, that fulfil all constraints but the caps of the others than traces and water; blocks of columns with traces, water and others.

    caps: the caps of the traces; water: its bounds, if there is one.
    """
    for traces, wet, shares in _draws(len(caps), water is not None, n_other, *args):
        traces = traces * np.minimum(TRACE_LINE, caps)[:, None]
        if water:
            wet = water[0] + (water[1] - water[0]) * wet
        rest = 100.0 - wet.sum(axis=0) - traces.sum(axis=0) - n_other * floor
        others = shares * rest + floor
        good = (rest >= 0) & (others[-1] >= TRACE_LINE)
        if water:
            good &= (others[0] - wet[0] <= 1e-12) & (wet[0] <= water[1] + 1e-12)
        yield np.concatenate([traces, wet, others])[:, good]


@lru_cache(KINDS_KEPT)
def _kept_draws(*kind) -> _Kept:
    return _Kept(_new_draws(*kind))


@lru_cache(KINDS_KEPT)
def _kept_rows(*kind) -> _Kept:
    return _Kept(_new_rows(*kind))


def _draws(n_trace: int, wet: bool, n_other: int, *args) -> Iterable[tuple]:
    return (_kept_draws if n_trace + n_other <= KEPT_ENTRIES else _new_draws)(n_trace, wet, n_other, *args)


def _rows(caps: tuple[float, ...], water: tuple[float, float] | None, n_other: int, *args) -> Iterable[np.ndarray]:
    return (_kept_rows if len(caps) + n_other <= KEPT_ENTRIES else _new_rows)(caps, water, n_other, *args)


def draw(listed: Listed, leave_on: bool, n_samples: int, seed: int, alpha: float = 1.0, floor: float = 0.0, water_prior: tuple[float, float] | None = None, decay: float | None = None) -> np.ndarray:
    """n_samples rows that fulfil all constraints, the first of the draws that do; Contradiction if too few do.

    The draws are the same for all lists with as many traces, water and others, so lists that differ in the others' caps only choose among the same rows.
    decay: the shares of the others than water are normalised Gammas whose shape falls by this factor from place to place, before they are put in order; without it they are
    alike (a Dirichlet draw).
    """
    if alpha <= 0 or (decay is not None and not 0 < decay <= 1):
        raise ValueError("alpha must be above 0, and decay above 0 and at most 1")
    low, high = water_prior or (WATER_LEAVE_ON if leave_on else WATER_RINSE_OFF)
    listed.check(low, high, floor)
    wet = ~listed.trace & listed.water
    other = ~listed.trace & ~wet
    caps = np.where(np.isnan(listed.cap), np.inf, listed.cap)
    bounds = (low, min(high, float(caps[wet][0]))) if wet.any() else None
    # others fall, so that only caps below all before them matter
    least = np.minimum.accumulate(caps[other])
    first = int((~other).sum())
    caps_at = [(first + k, least[k] + 1e-12) for k in range(len(least)) if least[k] < (least[k - 1] if k else np.inf)]
    found, kept = [], 0
    for rows in _rows(tuple(caps[listed.trace].tolist()), bounds, int(other.sum()), floor, n_samples, seed, alpha, decay):
        good = np.ones(rows.shape[1], bool)
        for k, cap in caps_at:
            good &= rows[k] <= cap
        found.append((rows, good))
        kept += int(np.count_nonzero(good))
        if kept >= n_samples:
            break
    if kept < n_samples:
        raise Contradiction(f"{kept} of {n_samples} samples after {n_samples * MAX_ROUNDS} draws")
    samples = np.empty((len(caps), n_samples))
    samples[np.concatenate([np.flatnonzero(x) for x in (listed.trace, wet, other)])] = np.concatenate([rows[:, good] for rows, good in found], axis=1)[:, :n_samples]
    return samples.T


def binding(listed: Listed, low: float, high: float, floor: float) -> np.ndarray:
    """The caps of a list that fulfils `check`, without those that no draw can reach: the k-th of the others has at most a k-th of what they share."""
    wet, other = ~listed.trace & listed.water, ~listed.trace & ~listed.water
    most = np.full(len(listed.cap), TRACE_LINE)
    most[wet] = high
    n = int(other.sum())
    # a little more, for shares are rounded
    most[other] = floor + (100 - (low if wet.any() else 0) - n * floor) / np.arange(1, n + 1) + 1e-6
    return np.where(listed.cap >= most, np.nan, listed.cap)


def upper_cap(leave_on: Column) -> Column:
    """The lowest of the caps that hold for a kind of product; nulls don't count."""
    return F.least("legal_cap", F.when(leave_on, F.col("max_leave_on")).otherwise(F.col("max_rinse_off")))


def listed_components(items: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """product_id, ingredient_id, position, is_trace, cap, water and leave_on of every placed link."""
    leave_on = rules.is_leave_on(F.col("category"))
    kinds = items.select("product_id", leave_on.alias("leave_on"))
    joined = links.where("position is not null").join(kinds, "product_id").join(components, "ingredient_id")
    water = (F.upper("inci_name").isin(WATER) | F.coalesce(F.col("cn_name") == "水", F.lit(False))) & (F.col("position") == 1)
    return joined.select("product_id", "ingredient_id", "position", "is_trace", upper_cap(F.col("leave_on")).alias("cap"), water.alias("water"), "leave_on")


def estimate(listed: DataFrame, n_samples: int = 2000, seed: int = 42, alpha: float = 1.0, floor: float = 0.0, water_leave_on: tuple[float, float] | None = None, decay: float | None = None) -> DataFrame:
    """product_id, ingredient_id, position, low, high (5 and 95 %), confidence and reason (null, or why there is no estimate)."""
    def prior(leave_on: bool) -> tuple[float, float]:
        return (water_leave_on if leave_on else None) or (WATER_LEAVE_ON if leave_on else WATER_RINSE_OFF)

    def lists(rows: pd.DataFrame, caps: str) -> Iterator[tuple[Listed, bool]]:
        for trace, water, cap, leave_on in zip(rows["trace"], rows["water"], rows[caps], rows["leave_on"], strict=True):
            cap = np.asarray(cap, float)
            yield Listed(np.asarray(trace, bool), np.asarray(water, bool), np.where(np.isinf(cap), np.nan, cap)), bool(leave_on)

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            reasons, caps = [], []
            for own, leave_on in lists(rows, "cap"):
                reason, cap = None, own.cap
                try:
                    own.check(*prior(leave_on), floor)
                    cap = binding(own, *prior(leave_on), floor)
                except Contradiction as problem:
                    reason = str(problem)
                reasons.append(reason)
                caps.append(np.where(np.isnan(cap), np.inf, cap))
            yield rows.assign(binding=caps, reason=reasons)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            lows, highs, reasons = [], [], []
            for own, leave_on in lists(rows, "binding"):
                low = high = reason = None
                try:
                    samples = draw(own, leave_on, n_samples, seed, alpha, floor, water_leave_on if leave_on else None, decay)
                    low, high = np.percentile(samples, [5, 95], axis=0)
                except Contradiction as problem:
                    reason = str(problem)
                lows.append(low)
                highs.append(high)
                reasons.append(reason)
            yield rows.assign(low=lows, high=highs, failed=reasons)

    mains = listed.groupBy("product_id").agg(F.sum((~F.col("is_trace")).cast("int")).alias("_mains"))
    counted = listed.join(mains, "product_id")
    too_long = counted.where(F.col("_mains") > MAX_MAIN).select("product_id", "ingredient_id", "position", *[F.lit(None).cast("double").alias(x) for x in ("low", "high", "confidence")], F.lit("more main components than 100 % can hold").alias("reason"))
    entry = F.struct("position", "ingredient_id", F.coalesce("is_trace", F.lit(False)).alias("trace"), F.coalesce("water", F.lit(False)).alias("water"), F.col("cap").cast("double").alias("cap"), F.coalesce("leave_on", F.lit(False)).alias("leave_on"))
    whole = counted.where(F.col("_mains") <= MAX_MAIN).groupBy("product_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    # lists with the same caps as far as they matter are one: in a falling list the least cap so far holds for all that follow, and no dose is above 100
    endless = F.lit(float("inf"))
    cap = lambda x: F.when(x["cap"].isNull() | F.isnan(x["cap"]) | (x["cap"] >= F.when(x["trace"], F.lit(TRACE_LINE)).otherwise(F.lit(100.0))), endless).otherwise(x["cap"])
    least = lambda so_far, x: F.when(x["trace"] | x["water"], so_far["least"]).otherwise(F.least(so_far["least"], cap(x)))
    start = F.struct(endless.alias("least"), F.array().cast("array<double>").alias("caps"))
    walked = F.aggregate("entries", start, lambda so_far, x: F.struct(least(so_far, x).alias("least"), F.concat(so_far["caps"], F.array(F.when(x["trace"] | x["water"], cap(x)).otherwise(least(so_far, x)))).alias("caps")))
    named = whole.select("product_id", "entries", F.get("entries", F.lit(0))["leave_on"].alias("leave_on"), F.col("entries.trace").alias("trace"), F.col("entries.water").alias("water"), walked["caps"].alias("cap"))
    named = materialize(named, "lists")
    kind = "leave_on boolean, trace array<boolean>, water array<boolean>"
    patterns = named.select("leave_on", "trace", "water", "cap").distinct()
    patterns = materialize(patterns.mapInPandas(checked, f"{kind}, cap array<double>, binding array<double>, reason string"), "patterns")
    shared = ["leave_on", "trace", "water", "binding"]
    # draws are the work: they are dealt evenly, lists that choose among the same rows beside one another
    capped = lambda which: F.filter(F.zip_with(which, "binding", lambda own, cap: F.when(own, cap)), lambda x: x.isNotNull())
    alike = [F.size("trace"), F.size(F.filter("trace", lambda x: x)), capped("trace"), "leave_on", capped("water"), "binding", "trace", "water"]
    to_draw = patterns.where("reason is null").select(*shared).distinct().repartitionByRange(DRAWING_TASKS, *alike).sortWithinPartitions(*alike)
    draws = materialize(to_draw.mapInPandas(drawn, f"{kind}, binding array<double>, low array<double>, high array<double>, failed string"), "draws")
    known = patterns.join(draws, shared, "left").select("leave_on", "trace", "water", "cap", "low", "high", F.coalesce("reason", "failed").alias("reason"))
    rows = named.join(known, ["leave_on", "trace", "water", "cap"]).select("product_id", "low", "high", "reason", F.posexplode("entries").alias("_at", "entry"))
    low, high = F.get("low", F.col("_at")), F.get("high", F.col("_at"))
    told = F.when(F.col("entry.water") | (F.col("entry.cap").isNotNull() & ~F.isnan("entry.cap")), F.lit(0.3)).otherwise(F.lit(0.0))
    confidence = F.when(low.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + told + F.lit(0.2) * (1 - (high - low) / 100))))
    found = rows.select("product_id", "entry.ingredient_id", "entry.position", low.alias("low"), high.alias("high"), confidence.alias("confidence"), "reason")
    return found.unionByName(too_long)


def anchor_coverage(estimates: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Disclosed doses, how many lie in their estimates, and the share; items without an estimate stay in the count."""
    joined = disclosed.join(estimates, ["product_id", "ingredient_id"], "left")
    hit = F.coalesce(dose.anchor_hit(F.col("low"), F.col("high"), F.col("disclosed")), F.lit(False))
    return joined.agg(F.count("*").alias("anchors"), F.sum(hit.cast("int")).alias("hits"), F.round(F.avg(hit.cast("double")), 4).alias("coverage"))
