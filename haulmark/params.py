"""Scenario parameters: the assumption set, the risk weights and the production network.

Parameters are driver-side configuration of a few dozen values. They enter a plan as literals, or,
for sweeps, as an array of structs that is exploded next to the rows it applies to, so that a sweep
over many settings is one job.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default assumption set.
FREIGHT_SPEED_KM_DAY = 900.0
FREIGHT_COST_PER_UNIT_PER_1000KM = 0.15
CAPABILITY_GAP_PENALTY = 0.20
CAPABILITY_TRANSITION_MULTIPLE = 2.0
MIN_ORDERS = 3
MIN_MATERIAL_DAYS = 1.0
CAPACITY_MULTIPLIER = 1.5
SPEED_WEIGHT = 0.5
RISK_WEIGHT = 0.30
IQR_FACTOR = 3.0
MONTE_CARLO_ITERATIONS = 300
BOOTSTRAP_ITERATIONS = 500
SELECTION_TOLERANCE = 0.02
LANE_MIN_ORDERS = 10
TOP_N = 10
SPEED_RANGE = (400.0, 1600.0)
RATE_RANGE = (0.05, 0.30)


@dataclass(frozen=True)
class Assumptions:
    """Inputs that turn a measured distance into days, money, gates and a ranking."""

    freight_speed_km_day: float = FREIGHT_SPEED_KM_DAY
    freight_cost_per_unit_per_1000km: float = FREIGHT_COST_PER_UNIT_PER_1000KM
    capability_gap_penalty: float = CAPABILITY_GAP_PENALTY
    capability_transition_multiple: float = CAPABILITY_TRANSITION_MULTIPLE
    min_orders_for_recommendation: float = MIN_ORDERS
    min_material_days: float = MIN_MATERIAL_DAYS
    capacity_multiplier: float = CAPACITY_MULTIPLIER
    speed_weight: float = SPEED_WEIGHT
    risk_weight: float = RISK_WEIGHT

    def replace(self, **changes: float) -> "Assumptions":
        """A copy with some values changed; unknown names raise ``TypeError``."""
        return dataclasses.replace(self, **changes)

    def columns(self) -> dict[str, Column]:
        """Every assumption as a literal column."""
        return {f.name: F.lit(float(getattr(self, f.name))) for f in dataclasses.fields(self)}

    def struct(self, **extra: Column) -> Column:
        """One struct holding all assumptions, plus any extra fields naming the scenario."""
        parts = [c.alias(n) for n, c in extra.items()]
        return F.struct(*parts, *[c.alias(n) for n, c in self.columns().items()])

    def version(self, network: "Network") -> Column:
        """SHA-256 fingerprint of the values that convert distance into days, cost and gates."""
        return F.sha2(F.lit(self.version_text(network)), 256)

    def version_text(self, network: "Network") -> str:
        """The canonical text behind :meth:`version`: values in order, then setup cost by site."""
        values = [self.freight_speed_km_day, self.freight_cost_per_unit_per_1000km,
                  self.capability_gap_penalty, self.capability_transition_multiple,
                  self.min_orders_for_recommendation, self.min_material_days,
                  self.capacity_multiplier]
        setup = sorted((s.name, s.setup_cost) for s in network.sites)
        return "|".join([f"{v:.6f}" for v in values] + [f"{n}={c:.6f}" for n, c in setup])


def scenario_columns(scenario: str | Column) -> dict[str, Column]:
    """The assumptions held in a scenario struct column, keyed like :meth:`Assumptions.columns`."""
    struct = F.col(scenario) if isinstance(scenario, str) else scenario
    return {f.name: struct[f.name] for f in dataclasses.fields(Assumptions)}


@dataclass(frozen=True)
class RiskWeights:
    """Weights of the four risk components and the level thresholds (fixed values)."""

    neg_profit: float = 0.40
    pred_variance: float = 0.30
    low_support: float = 0.20
    distance_shift: float = 0.10
    high: float = 0.50
    medium: float = 0.25


@dataclass(frozen=True)
class Site:
    name: str
    lat: float
    lon: float
    setup_cost: float


# Production sites with their coordinates and one-time setup costs.
DEFAULT_SITES = (
    Site("Lot's O' Nuts", 32.881893, -111.768036, 2.2),
    Site("Wicked Choccy's", 32.076176, -81.088371, 1.5),
    Site("Sugar Shack", 48.119140, -96.181115, 0.0),
    Site("Secret Factory", 41.446333, -90.565487, 2.8),
    Site("The Other Factory", 35.117500, -89.971107, 1.9),
)


@dataclass(frozen=True)
class Network:
    """The production sites a product may be made at; plans read them as ``dims.factories``."""

    sites: Sequence[Site] = field(default=DEFAULT_SITES)

    def __post_init__(self) -> None:
        if not self.sites:
            raise ValueError("a network needs a site")
        names = [s.name for s in self.sites]
        if len(set(names)) != len(names):
            raise ValueError("site names must be unique")

    @classmethod
    def of(cls, rows: Iterable[tuple[str, float, float, float]]) -> "Network":
        return cls(tuple(Site(*r) for r in rows))
