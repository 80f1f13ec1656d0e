"""Folds, reducers and counts over join trees, as DataFrame compositions."""
