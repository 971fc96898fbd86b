"""SQL that states each query's result independently of the Spark code."""
