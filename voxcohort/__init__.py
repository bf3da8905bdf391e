"""Cohort scoring and voxel analytics expressed as Spark DataFrame operations."""

__version__ = "0.1.0"
