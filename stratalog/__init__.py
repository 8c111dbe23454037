"""Catalogue analytics on Spark: routing, integrity analyses, delta reconciliation and sinks as DataFrame plans."""
