"""XML and HTML as tables on Spark."""
