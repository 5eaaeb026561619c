"""Campaign-delivery analytics as Spark DataFrame transformations."""
