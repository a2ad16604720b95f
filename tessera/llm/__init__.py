"""Operators of a training-data pipeline: deduplication, extraction, packing, formatting,
decontamination, quality, personal data and selection.  Nothing else in the library imports this."""
