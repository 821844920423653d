"""Where written tables go: the folder that driver and executors share."""

from ..storage import scratch, shared_folder, store

__all__ = ["scratch", "shared_folder", "store"]
