"""cytoplane: a PySpark-native analytics engine for annotated sparse matrices."""
