"""Doses as column expressions: factors, verdicts, costs, similarity of prices, skin penetration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.rules import PRESERVATIVE, first_of

#: The dose factor without an estimate, its highest value, and the line below which traces count as enough.
UNKNOWN_FACTOR, MAX_FACTOR, TRACE_LINE = 0.5, 1.5, 0.1
#: Limits of the penetration rules (molecular weight and logP) and the Potts-Guy coefficients.
MW_NONE, MW_HARD, LOGP_EASY, LOGP_LOW, LOGP_HIGH = 600.0, 500.0, (1.0, 3.0), 0.0, 4.0
POTTS_GUY = (-2.7, 0.71, 0.0061)
#: How far a disclosed dose may lie outside its estimate.
ANCHOR_TOLERANCE = 0.2


def floor4(value: Column) -> Column:
    """Four decimals, half up, of a value of 0 or more; a plain form that other engines repeat bit by bit."""
    return F.floor(value * 10000 + F.lit(0.5)) / F.lit(10000.0)


def _trace_rule(is_trace: Column, effective: Column) -> Column:
    return is_trace & (effective < TRACE_LINE)


def dose_factor(low: Column, high: Column, effective: Column, is_trace: Column) -> Column:
    """How sufficient an estimated dose is against the effective one, from 0 to MAX_FACTOR."""
    return first_of(
        [
            (effective.isNull() | (effective <= 0), F.lit(1.0)),
            (_trace_rule(is_trace, effective), F.lit(1.0)),
            (low.isNull() | high.isNull(), F.lit(UNKNOWN_FACTOR)),
            (F.lit(True), F.least(F.greatest((low + high) / 2 / effective, F.lit(0.0)), F.lit(MAX_FACTOR))),
        ]
    )


def dose_basis(low: Column, high: Column, effective: Column, is_trace: Column) -> Column:
    """Which rule gave the dose factor."""
    return first_of(
        [
            (effective.isNull() | (effective <= 0), F.lit("no_baseline")),
            (_trace_rule(is_trace, effective), F.lit("trace_line")),
            (low.isNull() | high.isNull(), F.lit("unknown_dose")),
            (F.lit(True), F.lit("interval")),
        ]
    )


def exclusion(level: Column, family: Column, kind: Column) -> Column:
    """Why an assertion doesn't count in a fingerprint; null if it does."""
    return first_of([(level == "regulation", F.lit("regulation")), (family == PRESERVATIVE, F.lit("preservative")), (kind == "supplier", F.lit("supplier"))])


def verdict(low: Column, high: Column, effective: Column, is_trace: Column) -> Column:
    """Where an estimated interval stands against the effective dose; null without an estimate."""
    return first_of(
        [
            (effective.isNull(), F.lit("unknown")),
            (_trace_rule(is_trace, effective), F.lit("trace_level")),
            (low.isNull() | high.isNull(), F.lit(None).cast("string")),
            (low >= effective, F.lit("effective")),
            (high < effective, F.lit("insufficient")),
            (F.lit(True), F.lit("uncertain")),
        ]
    )


def parse_volume(spec: Column) -> Column:
    """Millilitres (or grams) of a size such as "30ml"; null for any other form."""
    return F.regexp_extract(spec, r"(?i)^\s*(\d+(?:\.\d+)?)\s*(?:ml|g|毫升|克)\s*$", 1).try_cast("double")


def cost_per_dose(price: Column, volume: Column, dose: Column, effective: Column) -> Column:
    """Price of a day's millilitre, diluted to the effective dose; null if it can't be told."""
    return F.when(dose > 0, F.try_divide(price, volume) * effective / dose)


def price_similarity(a: Column, b: Column) -> Column:
    """The lower price over the higher one; null if a price is missing or none is above 0."""
    return F.when(a.isNotNull() & b.isNotNull() & (F.greatest(a, b) > 0), F.least(a, b) / F.greatest(a, b))


def cosine_min(shared: Column, norm_a: Column, norm_b: Column) -> Column:
    return shared / (norm_a * norm_b)


def ionic_rule(name: Column) -> Column:
    """Which naming rule marks a salt or charged form; null if none does."""
    words = F.split(F.btrim(F.upper(name)), r"\s+")
    has = lambda *some: F.arrays_overlap(words, F.array(*[F.lit(x) for x in some]))
    return first_of(
        [
            (has("PCA"), F.lit("pca")),
            (has("POTASSIUM", "DIPOTASSIUM"), F.lit("potassium")),
            (F.get(words, 0).isin("SODIUM", "DISODIUM"), F.lit("sodium")),
            (F.element_at(words, -1).endswith("ATE"), F.lit("ate")),
        ]
    )


def penetration_class(weight: Column, logp: Column, ionic: Column) -> Column:
    """easy, medium, hard or not_applicable, by molecular weight and logP of neutral small molecules."""
    return first_of(
        [
            (ionic | weight.isNull() | logp.isNull() | (weight > MW_NONE), F.lit("not_applicable")),
            (weight > MW_HARD, F.lit("hard")),
            (logp.between(*LOGP_EASY), F.lit("easy")),
            (logp.between(LOGP_LOW, LOGP_HIGH), F.lit("medium")),
            (F.lit(True), F.lit("hard")),
        ]
    )


def log_permeability(weight: Column, logp: Column) -> Column:
    base, by_logp, by_weight = POTTS_GUY
    return F.lit(base) + F.lit(by_logp) * logp - F.lit(by_weight) * weight


def anchor_hit(low: Column, high: Column, disclosed: Column) -> Column:
    return disclosed.between(low * (1 - ANCHOR_TOLERANCE), high * (1 + ANCHOR_TOLERANCE))


#: The ends of the dose axis, in percent.
AXIS = (0.01, 100.0)


def axis_place(value: Column) -> Column:
    """Where a dose stands on a logarithmic axis, in percent of its length; doses beyond its ends stand at them."""
    low, high = AXIS
    held = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), 100 * (F.log10(held) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def upper_cap(legal: Column, leave_on: Column, rinse_off: Column, opinion: Column, typical: Column, stays_on: Column) -> Column:
    """The least of the limits that are known, with the leave-on or the rinse-off limit as the product asks; null if none is."""
    return F.least(legal, F.when(stays_on, leave_on).otherwise(rinse_off), opinion, typical)
