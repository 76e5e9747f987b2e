"""tonekit: table operators for scored message corpora, built on Spark DataFrames."""
from .session import get_session, prepare  # noqa: F401

__version__ = "0.1.0"
