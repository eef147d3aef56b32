"""Status values and the small rules over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import is_blank

# Fixed values.
NORMALIZATION_STATUSES = ["NONE", "QUEUED", "PROCESSING", "READY", "FAILED"]
ANALYSIS_STATUSES = ["NONE", "READY", "REJECTED"]
JOB_STATUSES = ["QUEUED", "PROCESSING", "READY", "FAILED"]
ACTIVE_JOB_STATUSES = ["QUEUED", "PROCESSING"]
ASSET_STATUSES = [
    "GENERATING", "QA_PENDING", "QA_PASSED", "QA_FAILED", "REVIEW_REQUIRED", "APPROVED",
    "REJECTED", "PUBLISHED", "FAILED", "STALE_REFERENCE", "STALE_PROMPT", "SUPERSEDED",
]
ASSET_ROLES = ["REFERENCE_SEED", "DERIVED_CHARACTER", "STANDALONE_TEXT"]
PUBLISHABLE = ["QA_PASSED", "APPROVED", "PUBLISHED"]
STALE = ["STALE_REFERENCE", "STALE_PROMPT"]
RETRYABLE = ["FAILED", "QA_FAILED", "REVIEW_REQUIRED"]
FANOUT_SCOPES = ["MAIN_ONLY", "GRAPH_VISIBLE", "SELECTED", "STALE_ONLY", "FAILED_ONLY", "ALL"]
PUBLISH_POLICIES = ["MANUAL", "AUTO_AFTER_QA"]
GRAPH_SCOPES = ["book", "chapter", "event", "locator"]
BOOKMARK_SORTS = ["time_desc", "time_asc"]


def version_status(
    normalization: Column, rule: Column, locator: Column, current_rule: str, current_locator: str
) -> Column:
    same = rule.eqNullSafe(F.lit(current_rule)) & locator.eqNullSafe(F.lit(current_locator))
    return (
        F.when(~normalization.eqNullSafe(F.lit("READY")), "NOT_READY").when(same, "CURRENT").otherwise("OUTDATED")
    )


def chosen(raw: Column, allowed: list[str], default: str) -> Column:
    """A parameter value: the default when blank, null when not allowed."""
    value = F.when(is_blank(raw), F.lit(default)).otherwise(F.trim(raw))
    return F.when(value.isin(allowed), value)


def fanout_scope(raw: Column) -> Column:
    return chosen(raw, FANOUT_SCOPES, "MAIN_ONLY")


def publish_policy(raw: Column) -> Column:
    return chosen(raw, PUBLISH_POLICIES, "MANUAL")


def graph_scope(raw: Column) -> Column:
    return chosen(F.lower(raw), GRAPH_SCOPES, "book")


def bookmark_sort(raw: Column) -> Column:
    return chosen(F.lower(raw), BOOKMARK_SORTS, "time_desc")


def is_publishable(status: Column) -> Column:
    return status.isin(PUBLISHABLE)


def has_image(url: Column) -> Column:
    return ~is_blank(url)


def qa_failure(url: Column) -> Column:
    """Failure code of the basic image check, null when it passes."""
    return F.when(is_blank(url), F.lit("EMPTY_IMAGE_URL"))


def qa_result(url: Column, role: Column) -> Column:
    # Fixed values.
    failed = '{"passed":false,"reason":"EMPTY_IMAGE_URL"}'
    passed = F.concat(F.lit('{"passed":true,"mode":"BASIC_URL_CHECK","role":"'), role, F.lit('"}'))
    return F.when(is_blank(url), F.lit(failed)).otherwise(passed)
