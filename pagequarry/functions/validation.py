"""Validation of requests: on the driver for one, as predicates for tables of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules, text, urls

MAX_CONTENT = 100_000
OPERATION_ID = r"^[a-zA-Z0-9_-]{3,64}$"
OPERATION_PREFIXES = ("ex_", "proc_", "exp_")


class InvalidRequest(ValueError):
    pass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidRequest(message)


@dataclass
class ExtractRequest:
    url: str
    mode: str = "auto"
    parallel: bool = True
    max_depth: int = 5
    concurrency: int = 3
    use_ai: bool = True
    filters: dict[str, list[str]] = field(default_factory=dict)
    export_format: str = "both"

    def __post_init__(self):
        parts = urlparse(self.url)
        _require(parts.scheme in ("http", "https") and bool(parts.netloc), "url must be http or https")
        _require(self.mode in rules.MODES, f"mode must be one of {rules.MODES}")
        _require(1 <= self.max_depth <= 10, "max_depth must be between 1 and 10")
        _require(1 <= self.concurrency <= 10, "concurrency must be between 1 and 10")
        _require(set(self.filters) <= set(rules.FILTER_KINDS), f"filters must be among {rules.FILTER_KINDS}")
        _require(self.export_format in rules.EXPORT_FORMATS, f"format must be one of {rules.EXPORT_FORMATS}")
        if self.parallel and self.concurrency == 1:
            self.concurrency = 3
        if not self.parallel:
            self.concurrency = 1


@dataclass
class ProcessRequest:
    content: str
    content_type: str = "documentation"
    processing_mode: str = "clean"
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        _require(1 <= len(self.content) <= MAX_CONTENT, f"content must have 1 to {MAX_CONTENT} characters")
        _require(self.content_type in rules.CONTENT_TYPES, f"content_type must be one of {rules.CONTENT_TYPES}")
        _require(self.processing_mode in rules.PROCESSING_MODES, f"processing_mode must be one of {rules.PROCESSING_MODES}")
        lower = self.content.lower()
        if self.content.lstrip().startswith("<") and "</" in self.content and "<html" not in lower and "<body" not in lower:
            self.warnings.append("fragment")
        if "\n" not in self.content and len(self.content) > 500:
            self.warnings.append("single_line")


@dataclass
class ExportRequest:
    operation_id: str | None = None
    content_map: dict | None = None
    format: str = "both"
    project_name: str | None = None
    include_metadata: bool = True

    def __post_init__(self):
        _require(bool(self.operation_id or self.content_map), "operation_id or content_map is needed")
        _require(self.format in rules.EXPORT_FORMATS, f"format must be one of {rules.EXPORT_FORMATS}")
        _require(self.operation_id is None or bool(re.match(OPERATION_ID, self.operation_id)), "operation_id is malformed")
        _require(all(str(k).startswith("http") for k in self.content_map or {}), "content_map keys must be URLs")


@dataclass
class StatusRequest:
    operation_id: str
    include_details: bool = False

    def __post_init__(self):
        _require(bool(self.operation_id) and self.operation_id.startswith(OPERATION_PREFIXES), f"operation_id must start with one of {OPERATION_PREFIXES}")


def valid_extract() -> Column:
    """Over columns url, mode, max_depth, concurrency."""
    ok = F.col("url").rlike("^https?://[^/]") & F.col("mode").isin(*rules.MODES) & F.col("max_depth").between(1, 10) & F.col("concurrency").between(1, 10)
    return F.coalesce(ok, F.lit(False))


def content_checks(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with n_chars, valid, is_html and warnings of their content."""
    n = F.coalesce(F.length(content), F.lit(0))
    return rows.withColumns({"n_chars_checked": n, "valid": n.between(1, MAX_CONTENT), "is_html": F.coalesce(text.looks_like_html(content), F.lit(False)), "warnings": text.content_warnings(content)})


def valid_content_map(url: str = "url") -> Column:
    return F.coalesce(F.col(url).startswith("http") & (urls.netloc(url) != ""), F.lit(False))
