"""Compositions of operators into whole preparation steps."""
