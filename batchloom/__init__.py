"""A PySpark-native engine for statistical-batch jobs: DATA-step, PROC and SQL-dialect operators as lazy DataFrame plans."""
