"""Table reconciliation and evaluation scoring as Spark DataFrame plans."""
