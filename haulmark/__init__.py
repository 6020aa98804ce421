"""haulmark: order-network analytics as PySpark DataFrame transformations."""

from haulmark.params import Assumptions, Network, RiskWeights, Site

__all__ = ["Assumptions", "Network", "RiskWeights", "Site"]
