"""Registered checks grouped by operator family (see ``quarry.registry``)."""
