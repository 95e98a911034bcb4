"""Whole-table operators: lookups, reshaping, ordered aggregates."""
