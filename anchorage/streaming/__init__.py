from .reports import check_report_stream, read_report_stream

__all__ = ["check_report_stream", "read_report_stream"]
