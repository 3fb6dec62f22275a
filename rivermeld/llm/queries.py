"""All queries of this subpackage with their SQL."""

from rivermeld.llm import (  # noqa: F401
    decontamination,
    filter_audit,
    html_text,
    license_scan,
    line_dedup,
    merkle_manifest,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_files,
    url_filter,
)
from rivermeld.llm.shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
