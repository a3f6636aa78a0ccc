"""Tessella: telemetry and corpus analytics on Spark DataFrames."""
