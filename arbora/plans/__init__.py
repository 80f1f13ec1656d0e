"""Join graphs, join trees, the walker over Spark's plans, and the gate."""
