"""Operators for text collections that feed language models. Nothing else in the package imports this folder."""
