"""wayspark: trajectory and sequence analytics expressed as Spark plans."""
