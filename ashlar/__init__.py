"""Operators on Spark tables and streams for ledgers, decision records, dependency
graphs, review findings, task routing, install state and sampled signals."""
