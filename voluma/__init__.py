"""3D solids and geometry as ordinary Spark columns."""
