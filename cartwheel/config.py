"""Parameters of the jobs, with the defaults in use."""

from __future__ import annotations

from dataclasses import dataclass

HISTORY_SETS = {"prior": ("prior",), "all": ("prior", "train")}


@dataclass(frozen=True)
class Params:
    quantiles: int = 5
    reorder_candidates: int = 15
    popular_candidates: int = 20
    sample_users: int = 10_000
    test_share: float = 0.2
    seed: int = 42
    vocabulary: int = 10_000
    sequence_length: int = 20
    k_values: tuple[int, ...] = (5, 10, 20)
    history: str = "prior"
    user_feature_groups: tuple[str, ...] = (
        "order_patterns",
        "basket_patterns",
        "product_patterns",
        "department_aisle",
    )
    item_feature_groups: tuple[str, ...] = (
        "popularity",
        "reorder_patterns",
        "department_aisle",
    )
