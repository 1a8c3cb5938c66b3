"""All registered queries of this subpackage."""

from ledgerloom.llm import decontamination, hard_negatives, html_text, language_id, license_scan, mixing, near_dup, nearest, phrases, pii, sharding, topk, url_filter  # noqa: F401
from ledgerloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
