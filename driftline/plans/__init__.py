"""Planning on the driver: schema differences, query rewriting, validation."""
