"""wattframe: measuring and comparing training experiments with Spark DataFrames."""

from wattframe.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
