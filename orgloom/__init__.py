"""Organization contact-data quality and enrichment as Spark jobs."""

__version__ = "0.1.0"
