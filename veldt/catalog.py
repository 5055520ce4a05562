"""All registered queries of the measurement-analytics engine, with their SQL."""

from __future__ import annotations

from .plans import curve_queries, function_queries, image_queries, point_queries, pricing_queries, raster_queries, structure_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (point_queries, function_queries, raster_queries, curve_queries, structure_queries, image_queries, pricing_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
