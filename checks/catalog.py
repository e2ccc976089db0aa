"""Imports every module of checks so that their registrations are complete."""

from checks import (  # noqa: F401
    columns,
    identity_checks,
    journal_checks,
    ordering,
    plan_checks,
    records,
    source_checks,
    state_checks,
    stream_checks,
)
from checks.plan_checks import flagship  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
