"""Registered queries, grouped like the operator modules."""

from reelframe.plans import (  # noqa: F401
    boxes,
    depth,
    geometry,
    graph,
    sampling,
    scans,
    scoring,
    streams,
    telemetry,
    warping,
)
from reelframe.plans.registry import QUERIES, SQL  # noqa: F401
