from assayer.sources.session import local_session
from assayer.sources.tables import TABLES, read_delimited, read_metadata, read_with_rejects, table

__all__ = ["TABLES", "local_session", "read_delimited", "read_metadata", "read_with_rejects", "table"]
