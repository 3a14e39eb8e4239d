"""Plan search, cross-validated evaluation, end-to-end runs and comparison tables."""
