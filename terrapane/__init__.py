"""Tile-grid analytics on Spark: nested metre grids, class proportions, subset selection and catalogs."""
