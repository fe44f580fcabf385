"""Operators on free text and free-entered values for training-data pipelines."""
