"""Operators a training-data pipeline needs. Nothing else in the library imports this subpackage."""
