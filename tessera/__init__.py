"""Cohort analytics expressed as Spark DataFrame plans."""
