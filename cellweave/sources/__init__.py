"""Where arrays come from and go to."""

from .build import empty, from_fill, from_numpy, is_empty

__all__ = ["empty", "from_fill", "from_numpy", "is_empty"]
