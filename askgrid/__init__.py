"""Batch and streaming retrieval question-answering operators as Spark jobs."""

from askgrid.session import session

__all__ = ["session"]
