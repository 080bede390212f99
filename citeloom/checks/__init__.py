"""Checked queries; importing the modules fills the register."""

from citeloom.checks import jobs, sources, text, vectors  # noqa: F401
from citeloom.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
