"""DataFrame operators: rules, joins, ordering, text matching, raster and layout kernels."""
