"""Consolidation of event listings as Spark DataFrame plans."""
