"""Operators for preparing training text: filtering, de-duplication, scoring, packing and records."""
