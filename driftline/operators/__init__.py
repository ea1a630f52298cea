"""Transforms that change data as a schema evolves, and aggregates that score workloads."""
