"""Tables that cut lineage, as the rest of the library writes them."""

from ..sources.shared import Scratch, shared_dir, stored

__all__ = ["Scratch", "shared_dir", "stored"]
