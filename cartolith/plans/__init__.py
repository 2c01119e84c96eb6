"""Plans: options, projection specs, output grids and whole conversions."""
