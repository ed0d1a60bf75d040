"""Operators for preparing training text: dedup, scoring, decontamination, mixing, archives."""
