"""chatloom: chat-capture analytics on Spark DataFrames."""
