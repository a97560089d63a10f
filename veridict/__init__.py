"""veridict: a Spark-native engine for auditing claims and scoring the systems that audit them."""
