"""Reusable dataset operators: joins, ordering, window comparison, evaluation, checks."""
