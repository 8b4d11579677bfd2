"""Skyframe: trajectories, catalogs and close approaches of moving objects as Spark jobs."""

__version__ = "0.1.0"
