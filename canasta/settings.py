"""Knobs of the price run and of the review, as immutable values handed to each operator."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class PriceSettings:
    # Defaults that results depend on.
    min_good_matches: int = 5
    market_percent: float = 0.20
    price_basis: str = "regular"
    close_low: float = 0.67
    close_high: float = 1.50
    preferred_low: float = 0.80
    preferred_high: float = 1.25
    min_preferred: int = 3
    cluster_factor: float = 1.75
    fallback_per_store: int = 10
    raw_stop: int = 10
    spread_ratio_limit: float = 1.75
    spread_cv_limit: float = 0.30
    outlier_low: float = 0.50
    outlier_high: float = 2.00
    mad_z_limit: float = 3.5
    mad_floor: float = 0.05
    duplicate_size: float = 0.10
    duplicate_price: float = 0.15
    duplicate_jaccard: float = 0.80
    variety_factor: float = 1.5
    store_weight_cap: int = 3
    price_level: str = "economy"
    economy_percentile: float = 0.25
    snapshot_hours: int = 12
    change_limit: float = 0.20
    packaging_limit: float = 1.5
    size_warning: float = 1.15

    def __post_init__(self):
        if self.price_basis not in ("regular", "final"):
            raise ValueError("price_basis must be 'regular' or 'final'")
        if self.cluster_factor <= 1:
            raise ValueError("cluster_factor must be above 1")
        if not 0 <= self.economy_percentile <= 1:
            raise ValueError("economy_percentile must lie in 0..1")
        for low, high in (("close_low", "close_high"), ("preferred_low", "preferred_high"),
                          ("outlier_low", "outlier_high")):
            if not 0 < getattr(self, low) < getattr(self, high):
                raise ValueError(f"{low} must be positive and below {high}")

    @classmethod
    def from_mapping(cls, values: dict) -> "PriceSettings":
        """Override the defaults by name; each value is cast to the type of its default."""
        known = {f.name: type(f.default) for f in fields(cls)}
        unknown = set(values) - set(known)
        if unknown:
            raise ValueError(f"unknown setting(s): {', '.join(sorted(unknown))}")
        return cls(**{k: known[k](v) for k, v in values.items()})


@dataclass(frozen=True)
class ReviewPolicy:
    # The scoring policy.
    change_limit: float = 0.20
    target_stores: int = 3
    matches_per_store: int = 3
    weight_stores: float = 20.0
    weight_matches: float = 20.0
    weight_query: float = 20.0
    weight_current: float = 25.0
    weight_spread: float = 15.0
    query_credit: dict = field(default_factory=lambda: {"HIGH": 1.0, "MEDIUM": 0.65, "LOW": 0.25})
    missing_current_credit: float = 0.25
    boundaries: tuple = (25, 45, 65, 85)
    penalties: dict = field(default_factory=lambda: {
        "VERY HIGH RISK": 25, "HIGH RISK": 15, "LOW SEARCH CONFIDENCE": 5,
        "ONE STORE ONLY": 5, "TARGET SIZE WARNING": 20, "REQUEST ERROR": 10})
    caps: dict = field(default_factory=lambda: {
        "NO MATCHES": 1, "VERY HIGH RISK": 2, "HIGH RISK": 3, "TARGET SIZE WARNING": 2, "REQUEST ERROR": 3})
    unknown_penalty: int = 10
    large_change_cap: int = 3
    decimals: int = 2
