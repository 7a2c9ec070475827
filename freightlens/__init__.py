"""Delivery analytics as Spark DataFrame operators."""

from freightlens.session import build_session, reliable_checkpoint, tune

__all__ = ["build_session", "reliable_checkpoint", "tune"]
