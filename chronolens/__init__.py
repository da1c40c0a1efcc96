"""Point-in-time event-study analytics expressed as PySpark DataFrame transformations."""
