"""What the driver contract adds when this folder is present."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

LLM_QUERIES = dict(QUERIES)
LLM_ORACLES = dict(ORACLES)
