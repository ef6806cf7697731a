"""Superpixel and supervoxel segmentation, and training-data operators, as Spark dataflows."""
