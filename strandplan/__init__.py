"""Outside-plant network design analytics expressed as Spark DataFrame programs."""
