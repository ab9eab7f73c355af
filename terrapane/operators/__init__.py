"""DataFrame operators: grids, spatial joins, zonal statistics, subset selection, relational helpers."""
