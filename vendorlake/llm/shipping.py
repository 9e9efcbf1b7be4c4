"""The package's code for Python workers."""

from ..sources.shipping import ship

__all__ = ["ship"]
