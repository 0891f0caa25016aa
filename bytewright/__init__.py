"""Byte analytics and lossless recompression planning on Spark DataFrames."""
