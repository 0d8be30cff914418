"""signalmesh: a Spark-native engine that measures, compares and combines correlated feature columns of panels."""
