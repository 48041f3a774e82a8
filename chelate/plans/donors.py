"""Donor atoms by an adaptive bond-order threshold, their checks, and short shape strings, as expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelate.constants import DONORS

#: Bond orders that count for the threshold, its bounds, and what holds without any; reach without bond orders.
COUNTS, LEAST, MOST, DEFAULT, REACH, LOW = 0.01, 0.1, 0.5, 0.3, 2.8, 0.5


def adaptive_threshold(orders: str) -> str:
    """The 25th percentile (linear) of the bond orders that count, within bounds."""
    s = f"array_sort(filter({orders}, x -> x > {COUNTS}D))"
    at = "0.25D * (size(s) - 1)"
    value = f"s[int({at})] + (s[least(int({at}) + 1, size(s) - 1)] - s[int({at})]) * ({at} - int({at}))"
    return f"transform(array({s}), s -> CASE WHEN size(s) = 0 THEN {DEFAULT}D ELSE greatest({LEAST}D, least({MOST}D, {value})) END)[0]"


def with_donors(df: DataFrame, near: str = "near") -> DataFrame:
    """donors (idx, bond_order) and issues of rows with ``near``, the other atoms as (idx, distance, bo).

    With bond orders, what is above the threshold; without any (all null), what is nearer than
    REACH, with the inverse distance as its order.
    """
    df = df.withColumn("threshold", F.expr(adaptive_threshold(f"transform({near}, a -> coalesce(double(a.bo), 0D))")))
    known = f"exists({near}, a -> a.bo IS NOT NULL)"
    by_order = f"transform(filter({near}, a -> a.bo > threshold), a -> named_struct('idx', a.idx, 'bond_order', double(a.bo)))"
    by_distance = f"transform(filter({near}, a -> a.distance < {REACH}D), a -> named_struct('idx', a.idx, 'bond_order', 1 / a.distance))"
    df = df.withColumns({"known": F.expr(known), "donors": F.expr(f"CASE WHEN {known} THEN {by_order} ELSE {by_distance} END")})
    low = f"transform(filter(donors, d -> known AND d.bond_order < {LOW}D), d -> named_struct('code', 'LOW_BOND_ORDER', 'message', concat('Low BO (', format_number(d.bond_order, '0.00'), ') for donor ', d.idx), 'severity', 'info'))"
    none = "IF(size(donors) = 0, array(named_struct('code', 'NO_DONORS', 'message', 'No donor atoms found', 'severity', 'error')), array())"
    return df.withColumn("issues", F.expr(f"concat({low}, {none})")).drop("known")


def donor_issues(donors: str) -> str:
    """Messages on donors (idx, element) that are hydrogen or unusual."""
    usual = ", ".join(f"'{e}'" for e in DONORS)
    return f"filter(flatten(transform({donors}, d -> array(IF(d.element = 'H', concat('H atom at index ', d.idx, ' should not be a donor!'), NULL), IF(d.element NOT IN ({usual}), concat('Unusual donor element: ', d.element, ' at index ', d.idx), NULL)))), m -> m IS NOT NULL)"


def site_issues(sites: str) -> str:
    """Messages on sites (name, element, actual) whose element isn't the atom's, or is hydrogen."""
    return f"filter(flatten(transform({sites}, s -> array(IF(s.element <> s.actual, concat('Element mismatch: ', s.name, ' has element ', s.actual), NULL), IF(s.actual = 'H', concat('H cannot be a donor: ', s.name), NULL)))), m -> m IS NOT NULL)"


def nearest_k(neighbors: str, k: int | None) -> str:
    """The first k of ranked neighbours; all without a k."""
    return f"slice({neighbors}, 1, {k})" if k else neighbors


def shape_summary(names: str, values: str) -> str:
    """The best shape and how far the second is, in four steps; empty without a shape. Without a second the distance is 0."""
    ranked = f"array_sort(transform({names}, (n, i) -> named_struct('v', {values}[i], 'i', i, 'n', n)))"
    delta = "CASE WHEN size(r) < 2 OR r[1].v - r[0].v < 0.5 THEN 0 WHEN r[1].v - r[0].v < 2 THEN 1 WHEN r[1].v - r[0].v < 5 THEN 2 ELSE 3 END"
    return f"CASE WHEN coalesce(size({names}), 0) <= 0 THEN '' ELSE transform(array({ranked}), r -> concat('<ShapeBest:', r[0].n, '|Delta:', {delta}, '>'))[0] END"


def near_equal(a: Column, b: Column, atol: float = 0.1, rtol: float = 1e-5) -> Column:
    """Whether two arrays have the same length and agree everywhere within atol + rtol * abs(b)."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
