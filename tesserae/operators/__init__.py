"""Relational operators over volumes: normalisation, tiling, blending, segmentation, layers, weights."""
