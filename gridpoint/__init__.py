"""Published tables to spatial coordinates, as Spark DataFrame transformations."""
