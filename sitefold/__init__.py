"""Statistics over data that is split by rows across sites, on Spark."""

from .errors import BadInput, ColumnNotAllowed, PolicyViolation
from .frame import SiteFrame
from .policy import Policy

__all__ = ["BadInput", "ColumnNotAllowed", "Policy", "PolicyViolation", "SiteFrame"]
