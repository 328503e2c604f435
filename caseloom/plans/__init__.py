"""Compositions of operators: preparation, decision and evaluation."""
