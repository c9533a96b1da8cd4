"""Corpora made of the given tables, and the jobs that run over them end to end."""
