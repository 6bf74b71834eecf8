"""duskveil: find and mask sensitive data in log records and text tables, as Spark plans."""
