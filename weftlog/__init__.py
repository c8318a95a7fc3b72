"""Object-centric process analytics expressed as Spark DataFrame plans."""
