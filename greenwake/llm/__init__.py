"""Operators for training-data pipelines; nothing else in greenwake imports this subpackage."""
