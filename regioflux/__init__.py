"""Regional flow and hazard-risk analytics written as Spark DataFrame jobs."""
