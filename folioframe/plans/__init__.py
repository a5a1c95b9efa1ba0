"""Registered queries; importing the modules fills the registry."""

from folioframe.plans import decode_queries, geometry_queries, io_queries, job_queries, panel_queries, raster_queries, region_queries, text_queries  # noqa: F401
from folioframe.plans.registry import ORACLES, QUERIES  # noqa: F401
