"""Analytics over dense 2-D and 3-D images held as Spark DataFrames of voxels."""

from .volume import Volume

__all__ = ["Volume"]
