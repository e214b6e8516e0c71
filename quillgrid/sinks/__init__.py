"""Writers: run files, run tables and summaries."""
