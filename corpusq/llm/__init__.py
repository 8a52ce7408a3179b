"""Operators for preparing training text at scale, each one a DataFrame to DataFrame function."""
