"""Appending from streams."""

from .sink import append_stream

__all__ = ["append_stream"]
