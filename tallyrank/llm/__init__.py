"""Operators of a training-data pipeline: identification, filters, near copies, search,
fingerprints, formats, tokens and packing. Nothing outside this folder imports it."""
