"""Reconciliation analytics expressed as Spark DataFrame plans."""
