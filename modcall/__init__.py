"""modcall: single-molecule RNA-modification analytics as Spark DataFrame jobs."""
