"""Stateful folds over frame streams."""
