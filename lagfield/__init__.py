"""Lagged index features, empirical temperature physics and binned-regression
evaluation for satellite observation tables, expressed as Spark DataFrame plans."""
