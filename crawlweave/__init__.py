"""Site-analytics engine on Spark SQL."""
