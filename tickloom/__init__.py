"""tickloom: market and trade event analytics expressed as Spark DataFrame and streaming programs."""
