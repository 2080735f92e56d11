"""Column-level functions: spectral indices, band calibration, geometry, composites."""
