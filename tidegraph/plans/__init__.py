"""Iterative plans: a driver loop of rounds, each one query over written state."""
