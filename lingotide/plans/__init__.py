"""Compositions of operators into jobs, and the registered queries."""
