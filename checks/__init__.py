"""Registered queries and their SQL counterparts."""

from importlib import import_module

AREAS = ("features", "scores", "read_models", "training", "ingest")


def load():
    """Import every area and return the registry."""
    for area in AREAS:
        import_module(f"checks.{area}")
    return import_module("checks.base")
