"""Click analytics, click-model training and ad ranking as Spark DataFrame transformations."""

__version__ = "0.1.0"
