"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from tidecohort.plans import analytics, cleaning, cohorts, detection, features, files, planning, signals, training  # noqa: F401
from tidecohort.plans.register import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "window_plan_budget"
