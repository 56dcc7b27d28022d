"""Imports every query module, which fills the registry."""

from .base import ORACLES, QUERIES  # noqa: F401
from . import (token_queries, sequence_queries, note_queries,
               encode_queries, evaluate_queries, stats_queries, dataset_queries,
               stream_queries)  # noqa: F401,E402
