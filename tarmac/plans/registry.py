"""Queries by name and their SQL twins."""

from __future__ import annotations

from tarmac.plans import analysis, reports, rows, selection  # noqa: F401
from tarmac.plans.common import ORACLES, QUERIES  # noqa: F401
