"""Operators of a training-data pipeline: scoring, deduplication, mixing, encoding, packing, search.

Nothing outside this folder imports it. Each operator is a module with a general interface;
``queries`` applies them to the driver tables with production parameters.
"""
