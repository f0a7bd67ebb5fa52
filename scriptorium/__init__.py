"""Bibliographic record collections on Spark: scan, repair, merge, filter, profile, audit, compare, recover citations, write."""

from .functions.biblio import bibtex_key, parse_bibtex
from .functions.ids import author_signature, describe_signature, parse_id, parse_signature, parse_user, search_signature, work_key
from .functions.urls import author_url, cite_url, redact_url, search_url
from .operators.audit import audit_counts, checks
from .operators.biblio import bibliography, new_entries, unique_keys
from .operators.components import connected_components
from .operators.delta import compare
from .operators.filters import cap_per_target, check_pages, classify_challenge, filter_records
from .operators.graph import build_edges, component_sizes, follow, network_summary, next_level, nodes_of
from .operators.history import scd2_history, scd2_merge
from .operators.merge import merge_richest, new_rows
from .operators.packed import author_names
from .operators.planning import Budget, advise, plan_cost, plan_text
from .operators.stale import rank_stale, refresh_targets
from .operators.summary import group_profile, overview
from .plans.digest import Digest, DigestError, Settings, document, merge_records, run
from .plans.report import build_report
from .session import get_session
from .sources.html import bibtex_link, profile_headers, profile_rows, register_page_functions, result_cards
from .sources.jsonl import parse_lines, read_records
from .sources.sinks import upsert, upsert_cursors, write_csv, write_jsonl

__all__ = [
    "Budget", "Digest", "DigestError", "Settings", "advise", "audit_counts", "author_names", "author_signature", "author_url", "bibliography", "bibtex_key", "bibtex_link", "build_edges", "build_report",
    "cap_per_target", "check_pages", "checks", "cite_url", "classify_challenge", "compare", "component_sizes", "connected_components", "describe_signature", "document", "filter_records", "follow", "get_session",
    "group_profile", "merge_records", "merge_richest", "network_summary", "new_entries", "new_rows", "next_level", "nodes_of", "overview", "parse_bibtex", "parse_id", "parse_lines", "parse_signature", "parse_user",
    "plan_cost", "plan_text", "profile_headers", "profile_rows", "rank_stale", "read_records", "redact_url", "refresh_targets", "register_page_functions", "result_cards", "run", "scd2_history", "scd2_merge",
    "search_signature", "search_url", "unique_keys", "upsert", "upsert_cursors", "work_key", "write_csv", "write_jsonl",
]
