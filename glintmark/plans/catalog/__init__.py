"""Every registered query, by area."""

from glintmark.plans.catalog import evals, findings, formats, graphs, projects, runs, streams, texts  # noqa: F401
from glintmark.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
