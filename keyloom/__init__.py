"""keyloom: a batch key/value analytics engine expressed with Spark DataFrames."""
