"""Tables written between the steps of a job."""

from ..sources.scratch import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "written"]
