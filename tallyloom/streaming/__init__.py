"""Streaming variants, beyond what a closed batch needs."""
