"""garimpo: prospecting analytics over open registries, written for PySpark."""
