"""Operators of a training-data pipeline: formatting, archiving, scoring, deduplication, packing, encoding."""
