"""Queries; importing the package fills the catalog."""

from . import catalog, composition_queries, framed_queries, layout_queries, maturity_queries, metric_queries, quality_queries, region_queries, section_queries

__all__ = ["catalog", "composition_queries", "framed_queries", "layout_queries", "maturity_queries", "metric_queries", "quality_queries", "region_queries", "section_queries"]
