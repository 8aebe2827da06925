"""Grounded extraction and document analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"

from .api import Extractor, extract
from .config import Limits, Options, Schema
from .data import AnnotatedDocument, CharInterval, ExampleData, Extraction
from .operators.decisions import CachedDecider, HashDecider, LookupDecider, MemoryCache, TableCache

__all__ = ["AnnotatedDocument", "CachedDecider", "CharInterval", "ExampleData", "Extraction", "Extractor", "HashDecider", "Limits", "LookupDecider", "MemoryCache", "Options", "Schema", "TableCache", "extract"]
