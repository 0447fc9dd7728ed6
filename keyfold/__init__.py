"""A PySpark-native engine for keyed map-and-fold dataflows, graphs and iterative learning."""
