"""Readers, append-only attempt log, plan memory and CSV export."""
