"""Sources that Spark reads by name."""
