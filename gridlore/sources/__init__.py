"""Readers and writers: Parquet pixels, features, GeoTIFF."""
