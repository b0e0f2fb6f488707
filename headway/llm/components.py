"""Connected components, as the library has them."""

from __future__ import annotations

from ..graph import components

__all__ = ["components"]
