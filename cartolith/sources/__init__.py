"""Sources: label text, cube files and the driver's tables."""
