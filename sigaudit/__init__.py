"""Auditing classifiers over windowed signals, as DataFrame transformations."""
