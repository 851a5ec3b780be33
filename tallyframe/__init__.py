"""Reconciliation and corpus analytics as declarative Spark plans."""
