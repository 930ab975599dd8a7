"""quern: a Spark-native engine for positional column queries and table analytics."""
