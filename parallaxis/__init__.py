"""Spatial camera, point-cloud and voxel analytics expressed as Spark DataFrames."""
