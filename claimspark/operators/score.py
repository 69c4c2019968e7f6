"""Scores of an institution: fit over six components, confidence, and the gate before both. Column expressions only.

Points are held in tenths as whole numbers until the one division, so results don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of model fit_v1.
MAX_POINTS = {"affordability": 30, "pcm_12_volume": 25, "curriculum_tier": 15, "geography": 15, "accessibility": 10, "group_leverage": 5}
MIN_POSSIBLE = 40
FEE_UPTO = [(50000, 0), (100000, 6), (150000, 15), (300000, 30), (600000, 28), (1000000, 22), (None, 16)]
PCM_FROM = [(300, 25), (200, 22), (120, 18), (60, 12), (25, 6), (0, 2)]
CURRICULUM = {"IB_DP": 15, "CAIE_ALEVEL": 15, "CISCE_ISC": 12, "CBSE": 10, "IB_PYP": 0, "IB_MYP": 0, "CAIE_IGCSE": 0}
CURRICULUM_DEFAULT = 5
DISTRICTS = {"bengaluru urban": 15, "bengaluru rural": 15}
METROS = {"Bengaluru": 15, "Hyderabad": 11, "Chennai": 11, "Pune": 11, "MMR (Mumbai)": 11, "Delhi NCR": 9, "Kolkata": 9, "Ahmedabad": 9, "Coimbatore": 8, "Mysuru": 8, "Kochi": 8, "Visakhapatnam": 8, "Mangaluru": 8}
STATES = {"karnataka": 12}
ELSEWHERE = 3
GROUP_FROM = [(20, 5), (5, 3), (2, 1), (0, 0)]
FRANCHISE_CAP = 1
TIER_POINTS = {1: 20, 2: 16, 3: 11, 4: 4}
FRESH_MONTHS = [(6, 20), (12, 12), (24, 6)]
SCIENCE = ("PCM", "PCMB")


def points_upto(value: Column, bands: list) -> Column:
    """Points of the first band whose limit is above ``value``; a limit of None takes the rest; null stays null."""
    out = F.when(value.isNull(), None)
    for limit, points in bands:
        out = out.otherwise(F.lit(points)) if limit is None else out.when(value < limit, points)
    return out


def points_from(value: Column, bands: list) -> Column:
    """Points of the first band, highest first, that ``value`` reaches."""
    out = F.when(value.isNull(), None)
    for start, points in bands:
        out = out.when(value >= start, points)
    return out


def _lookup(key: Column, points: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in points.items() for x in pair]), key)


def headcount(pcm: Column, class_12_total: Column, enrollment: Column, grade_low: Column) -> Column:
    """struct(value, estimated): as observed, else 45 % of class 12, else 6 % of one that spans all grades."""
    spans = F.coalesce(grade_low, F.lit(1)) <= 5
    guess = F.coalesce(F.bround(class_12_total * 0.45), F.when(spans, F.bround(enrollment * 0.06))).cast("long")
    return F.struct(F.coalesce(pcm.cast("long"), guess).alias("value"), (pcm.isNull() & guess.isNotNull()).alias("estimated"))


def components(*, fee: Column, head: Column, boards: Column, district: Column, metro: Column, state: Column, counsellor: Column, principal_fresh: Column, email: Column, phone: Column, campuses: Column, franchise: Column) -> dict[str, Column]:
    """Tenths of points by component, null where there is no data. One without a group has data there: 0."""
    tier = F.array_max(F.transform(boards, lambda b: F.coalesce(_lookup(b, CURRICULUM), F.lit(CURRICULUM_DEFAULT))))
    place = F.coalesce(_lookup(F.lower(district), DISTRICTS), _lookup(metro, METROS), _lookup(F.lower(state), STATES), F.when(F.coalesce(district, metro, state).isNotNull(), ELSEWHERE))
    reach = sum((F.when(has, p).otherwise(0) for has, p in ((counsellor, 4), (principal_fresh, 3), (email, 2), (phone, 1))), F.lit(0))
    group = F.coalesce(points_from(campuses, GROUP_FROM), F.lit(0))
    return {
        "affordability": points_upto(fee, FEE_UPTO) * 10,
        "pcm_12_volume": points_from(head["value"], PCM_FROM) * F.when(head["estimated"], 6).otherwise(10),
        "curriculum_tier": tier * 10,
        "geography": place * 10,
        "accessibility": F.when(reach > 0, F.least(reach, F.lit(MAX_POINTS["accessibility"]))) * 10,
        "group_leverage": F.when(franchise, F.least(group, F.lit(FRANCHISE_CAP))).otherwise(group) * 10,
    }


def fit(parts: dict[str, Column]) -> Column:
    """struct(earned, possible, fit): share of the points possible where there is data; null below 40 possible."""
    earned = sum((F.coalesce(c, F.lit(0)) for c in parts.values()), F.lit(0))
    possible = sum((F.when(c.isNull(), 0).otherwise(MAX_POINTS[n]) for n, c in parts.items()), F.lit(0))
    return F.struct((earned / 10).alias("earned"), possible.alias("possible"), F.when(possible >= MIN_POSSIBLE, F.bround(10 * earned / possible, 1)).alias("fit"))


def confidence(present: list[Column], tiers: Column, oldest: Column, now: Column) -> Column:
    """60 by the share of fields present, up to 20 by the mean of distinct source tiers, up to 20 by the oldest claim."""
    have = sum((F.when(p, 1).otherwise(0) for p in present), F.lit(0))
    total = F.aggregate(F.transform(tiers, lambda t: F.coalesce(_lookup(t, TIER_POINTS), F.lit(0))), F.lit(0), lambda a, x: a + x)
    authority = F.when(F.size(tiers) > 0, F.least(total / F.size(tiers), F.lit(20.0))).otherwise(0.0)
    months = F.timestamp_diff("DAY", oldest, now) / 30.44
    fresh = F.when(oldest.isNull(), 0)
    for limit, points in FRESH_MONTHS:
        fresh = fresh.when(months <= limit, points)
    return F.bround(F.least(60.0 * have / len(present) + authority + fresh.otherwise(0), F.lit(100.0)), 1)


def gate_reason(class_12: Column, status: Column, excluded: Column, streams: Column) -> Column:
    """Why a row is not scored, the first that holds; null if it is. Unknown class 12 fails, unknown streams pass."""
    science = F.coalesce(F.size(streams), F.lit(0)) == 0
    for s in SCIENCE:
        science = science | F.array_contains(streams, s)
    return F.when(~F.coalesce(class_12, F.lit(False)), "no class 12").when(~F.coalesce(status == "active", F.lit(False)), "not active").when(F.coalesce(excluded, F.lit(False)), "excluded").when(~science, "no science stream")
