"""Column functions: latitudes, projections and value maps, each also in numpy."""
