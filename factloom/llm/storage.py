"""Intermediate tables in the folder that the driver and every executor share; see the library's ``storage``."""

from __future__ import annotations

from ..storage import cut as materialize
from ..storage import discard, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]
