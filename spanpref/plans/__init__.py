"""Named end-to-end queries (``queries``) and their DuckDB oracle SQL (``oracle``)."""
