"""Raster and table analytics on Spark: images, tiles, layers and edit logs as ordinary tables."""
