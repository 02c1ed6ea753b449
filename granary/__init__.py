"""A document-style query engine on Spark DataFrames."""

from .engine import Config, Engine
from .errors import GranaryError
from .events import Receipt
from .schema import Collection, Field, Index

__all__ = ["Collection", "Config", "Engine", "Field", "GranaryError", "Index", "Receipt"]
