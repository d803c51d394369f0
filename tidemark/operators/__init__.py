"""Operators on tables of bars and signals."""
