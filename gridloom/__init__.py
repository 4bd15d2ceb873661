"""Functions from integer coordinates to values, compiled to Spark DataFrame plans."""
