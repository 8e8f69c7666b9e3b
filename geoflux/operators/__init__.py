"""Spatial join operators as plans of ordinary DataFrame operations."""

from .knn import knn_join
from .spatial_join import distance_join, spatial_join

__all__ = ["distance_join", "knn_join", "spatial_join"]
