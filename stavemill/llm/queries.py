"""Imports every operator module, which fills the registry."""

from .common import ORACLES, QUERIES  # noqa: F401
from . import (chat, decontam, exact_dedup, hard_negatives, langid, merkle, minhash, mixing,  # noqa: F401
               page_text, quality, secret_scan, sharding, warc)  # noqa: F401
