"""Transcript sources. Importing the package registers all of them."""

from tracelake.sources import jsonl, stores  # noqa: F401
from tracelake.sources.base import REGISTRY, ingest  # noqa: F401
