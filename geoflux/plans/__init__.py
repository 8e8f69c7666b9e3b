"""Building blocks of plans: bounds, grids and checked broadcasts."""

from .grid import bounds, cell_levels, small_enough

__all__ = ["bounds", "cell_levels", "small_enough"]
