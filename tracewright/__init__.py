"""Spark-native segmentation of seismic sections, and training-data operators.

Sections are tables of traces; every step takes DataFrames and returns lazy
DataFrames.  See README.md for the map from operators to modules.
"""

__version__ = "0.1.0"
