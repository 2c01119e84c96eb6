"""Sinks: tiled GeoTIFF and label files."""
