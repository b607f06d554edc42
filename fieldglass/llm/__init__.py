"""Operators of a training-data pipeline, each named after its method. Nothing outside this folder imports it."""
