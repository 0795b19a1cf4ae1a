"""Structured Streaming helpers."""

from .windows import sessions, stream_table, windowed

__all__ = ["sessions", "stream_table", "windowed"]
