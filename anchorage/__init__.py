"""Link-integrity analytics over document collections, as Spark jobs."""

from .operators.extract import (
    document_anchor_sets,
    document_anchors,
    extract_headings,
    extract_links,
    index_documents,
    index_responses,
    list_anchors,
    response_anchors,
)
from .operators.fragments import resolve_fragments
from .operators.outcomes import inventory, local_outcomes, look_up, remote_outcomes
from .operators.redirects import resolve_redirects, resolve_responses
from .operators.targets import accepted, distinct_targets, group_targets, parse_targets, rejected, rewrite_links
from .plans.check import check_links, extract_only, stage_index
from .plans.report import (
    explain_details,
    format_report,
    in_input_order,
    mute,
    tag_counts,
    tag_lookup,
    write_report,
)
from .schemas import parse_tag, tags
from .sources import (
    documents_from_table,
    malformed_lines,
    parse_records,
    read_documents,
    read_report,
    rejected_responses,
    responses_from_table,
    union_documents,
    unreadable_documents,
)

__all__ = [
    "accepted", "check_links", "distinct_targets", "document_anchor_sets", "document_anchors",
    "documents_from_table", "explain_details", "extract_headings", "extract_links", "extract_only",
    "format_report", "group_targets", "in_input_order", "index_documents", "index_responses",
    "inventory", "list_anchors", "local_outcomes", "look_up", "malformed_lines", "mute",
    "parse_records", "parse_tag", "parse_targets", "read_documents", "read_report", "rejected",
    "remote_outcomes", "resolve_fragments", "resolve_redirects", "resolve_responses",
    "response_anchors", "stage_index", "rejected_responses", "responses_from_table", "rewrite_links", "tag_counts", "tag_lookup", "tags",
    "union_documents", "unreadable_documents", "write_report",
]
