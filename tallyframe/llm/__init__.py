"""Operators of a training-data pipeline: cleaning, searching, formatting, sharding and packing."""
