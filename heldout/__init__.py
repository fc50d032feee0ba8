"""Held-out-group cohort analytics as Spark DataFrame operators."""
