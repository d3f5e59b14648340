"""seglake: timed token streams and conversation transcripts on Spark."""

from .session import build_session

__all__ = ["build_session"]
