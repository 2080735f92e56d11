"""Validated configurations and the pipelines they describe."""
