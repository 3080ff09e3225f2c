"""A corpus analytics engine on PySpark: sources, layers, text metrics, dashboards."""
