"""loomline: text-intelligence analytics expressed as Spark DataFrame plans."""
