"""Ordered rule tables turned into one ``CASE`` expression (first match wins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A bound is (lowest, highest) for a score in 1..5; a rule lists bounds for R, F, M.
Bound = tuple[int, int]
Rule = tuple[str, Bound, Bound, Bound]

ANY: Bound = (1, 5)


def at_least(n: int) -> Bound:
    return (n, 5)


def at_most(n: int) -> Bound:
    return (1, n)


# Labels and score bounds (R, F, M) of the three segmentations.
# Rules that an earlier rule always shadows stay listed, as documentation.
STANDARD_RULES: tuple[Rule, ...] = (
    ("Champions", at_least(4), at_least(4), at_least(4)),
    ("Loyal_Customers", at_least(4), at_least(4), at_least(2)),
    ("Potential_Loyalists", at_least(4), at_least(2), at_least(2)),
    ("New_Customers", at_least(4), at_most(2), ANY),
    ("Promising", at_least(2), at_most(2), at_least(4)),
    ("Need_Attention", at_least(2), at_least(2), at_least(4)),
    ("About_to_Sleep", at_most(2), at_least(2), at_least(2)),
    ("At_Risk", at_most(2), at_least(4), at_least(4)),
    ("Cannot_Lose_Them", at_most(2), at_least(4), at_least(4)),
)
STANDARD_DEFAULT = "Hibernating"

DETAILED_RULES: tuple[Rule, ...] = (
    ("Champions", at_least(4), at_least(4), at_least(4)),
    ("Loyal Customers", at_least(3), at_least(4), at_least(3)),
    ("Potential Loyalists", at_least(4), at_least(2), at_least(2)),
    ("New Customers", at_least(4), at_most(1), ANY),
    ("Promising", at_least(3), at_least(2), at_least(2)),
    ("Need Attention", at_least(3), at_least(2), at_most(2)),
    ("About to Sleep", at_least(2), at_least(2), ANY),
    ("At Risk", at_most(2), at_least(3), ANY),
    ("Cannot Lose", at_most(2), at_least(4), at_least(4)),
    ("Hibernating", at_most(2), at_most(2), at_least(3)),
)
DETAILED_DEFAULT = "Lost"

DISPLAY_RULES: tuple[Rule, ...] = (
    ("🏆 Champions", ANY, at_least(4), at_least(4)),
    ("💎 Loyal Customers", ANY, at_least(3), at_least(3)),
    ("🌟 New Customers", at_least(4), ANY, ANY),
    ("💪 Potential Loyalists", ANY, at_least(4), ANY),
    ("⚠️ At Risk", at_most(2), ANY, ANY),
)
DISPLAY_DEFAULT = "😴 Hibernating"

# Stored segment -> display segment.
DISPLAY_NAMES = {
    "Champions": "🏆 Champions",
    "Loyal Customers": "💎 Loyal Customers",
    "New Customers": "🌟 New Customers",
    "Potential Loyalists": "💪 Potential Loyalists",
    "At Risk": "⚠️ At Risk",
    "About to Sleep": "😴 Hibernating",
    "Need Attention": "⚠️ At Risk",
    "Cannot Lose Them": "🆘 Can't Lose",
    "Hibernating": "😴 Hibernating",
}


def _inside(score: Column, bound: Bound) -> list[Column]:
    low, high = bound
    tests = []
    if low > ANY[0]:
        tests.append(score >= low)
    if high < ANY[1]:
        tests.append(score <= high)
    return tests


def label(rules: tuple[Rule, ...], default: str, r: Column, f: Column, m: Column) -> Column:
    case = F
    for name, *bounds in rules:
        tests = [t for score, b in zip((r, f, m), bounds) for t in _inside(score, b)]
        case = case.when(reduce(Column.__and__, tests), F.lit(name))
    return case.otherwise(F.lit(default))
