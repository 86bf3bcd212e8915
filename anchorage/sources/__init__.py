from .documents import (
    documents_from_table,
    read_documents,
    union_documents,
    unreadable_documents,
)
from .reports import malformed_lines, parse_records, read_report
from .responses import rejected_responses, responses_from_table

__all__ = [
    "documents_from_table", "malformed_lines", "parse_records", "read_documents", "read_report",
    "rejected_responses", "responses_from_table", "union_documents", "unreadable_documents",
]
