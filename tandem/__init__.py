"""Record reconciliation and change-data processing as Spark DataFrame jobs."""
