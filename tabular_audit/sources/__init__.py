"""Tables in, reports out."""

from .published import manifest, publish_reports, read_report as read_published
from .rejects import read_lenient
from .reports import write_report, write_reports
from .schemas import SCHEMAS
from .shelf import Shelf
from .tables import check_schema, kept, read_portfolio, read_table, shared_folder

__all__ = [
    "SCHEMAS", "Shelf", "check_schema", "kept", "manifest", "publish_reports", "read_lenient",
    "read_portfolio", "read_published", "read_table", "shared_folder", "write_report", "write_reports",
]
