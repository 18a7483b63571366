"""docloom: extraction, validation and operational analytics of financial documents as Spark DataFrame jobs."""

__version__ = "0.1.0"
