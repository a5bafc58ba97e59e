"""Four-dimensional diffraction analytics as Spark DataFrame operations."""
