"""Perturbation scoring and sparse-matrix analytics as Spark DataFrame operators."""

from shiftgrid.session import get_session

__all__ = ["get_session"]
