"""Tesserae: tiled inference over dense volumes as Spark dataflow.

A volume is a DataFrame of voxels (``volume_id, c, z, y, x, v``).  Normalisation is a
projection over a small parameter table, tiling a narrow expansion of voxels into the
patches that cover them, a network a chain of joins and aggregates or one Arrow function
per patch, and blending a weighted aggregate.
"""

from .engine import Engine, ModelBundle

__all__ = ["Engine", "ModelBundle"]
