"""Imports the modules that register queries."""

from veilstat.plans import large, models, resampling, statistics, tables  # noqa: F401
