"""Statement-log analytics, table replication and metric series on Spark DataFrames."""
