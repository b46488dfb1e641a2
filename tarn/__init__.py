"""A Spark-native analytics engine for nested catalogues and the graph of facts around them."""
