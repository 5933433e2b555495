"""wirelake: packet-stream analytics expressed as Spark DataFrame plans."""
