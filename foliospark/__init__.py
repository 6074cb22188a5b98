"""Analytics over semi-structured HR absence documents, as Spark DataFrame and SQL operators."""
