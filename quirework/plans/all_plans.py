"""Imports every plan module so that its queries are registered."""

from quirework.plans import (
    answer_plans,
    evaluation_plans,
    ingest_plans,
    layout_plans,
    page_plans,
    quality_plans,
    registry_plans,
    retrieval_plans,
    source_plans,
    stream_plans,
    text_plans,
)
from quirework.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answer_plans", "evaluation_plans", "ingest_plans", "layout_plans", "page_plans", "quality_plans", "registry_plans", "retrieval_plans", "source_plans", "stream_plans", "text_plans"]
