"""Where 3D values come from: WKB columns, city models in JSON, and built fixtures."""
