"""Operators of a training-data pipeline: tokenising, packing, deduplication, licences, quality, chat."""
