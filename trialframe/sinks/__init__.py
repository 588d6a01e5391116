"""Writers for result tables, charts, run tables and job states."""
