"""Data operators: profile, issues, prep, folds, metrics, features, models, neighbours, clusters, vocabulary, goals."""
