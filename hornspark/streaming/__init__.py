"""Streams of facts: each micro-batch goes into a relation, and what depends on it is made anew."""

from hornspark.streaming.live import Live

__all__ = ["Live"]
