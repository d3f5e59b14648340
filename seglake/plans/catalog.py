"""All registered queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("filters", "joins", "aggregates", "windows", "scoring", "logs", "formats", "segments", "feed", "exports", "sets", "streams"):
    try:
        import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"{__package__}.{_name}":
            raise

__all__ = ["ORACLES", "QUERIES"]
