"""Memory, retrieval and evaluation jobs as Spark DataFrame operators."""
