"""Lending analytics on Spark: as-of reports, searches, audits, batch ingest and exports."""

from lendlens.sources.library import Library, read_library, write_library

__all__ = ["Library", "read_library", "write_library"]
