"""sitequarry: a PySpark-native sitemap analytics engine."""

__version__ = "0.1.0"
