"""Credential-exposure analytics over Spark DataFrames."""

from credtrail.rules import (
    ExtractionPattern,
    KeywordGroup,
    Rules,
    alternative_rules,
    default_rules,
    load_rules,
)

__all__ = [
    "ExtractionPattern",
    "KeywordGroup",
    "Rules",
    "alternative_rules",
    "default_rules",
    "load_rules",
]
