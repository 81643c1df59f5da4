"""Log-template analytics expressed as Spark DataFrame operators."""
