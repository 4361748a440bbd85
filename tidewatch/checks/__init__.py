"""Registered queries and their SQL equivalents, grouped by area."""


def load():
    import importlib

    from tidewatch.checks.registry import ORACLES, QUERIES

    for area in AREAS:
        importlib.import_module(f"tidewatch.checks.{area}")
    return QUERIES, ORACLES


AREAS = ["parsing", "engine", "shaping", "casework", "detections", "streams"]
