"""One query per operator over the driver's tables, with the equivalent SQL where there is one."""

from opinionmill.plans.catalogue import (  # noqa: F401
    contrasting,
    evaluating,
    featuring,
    growing,
    modelling,
    preparing,
    probing,
    relating,
    scoring,
    topicking,
)
from opinionmill.plans.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
