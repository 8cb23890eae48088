"""agentframe: agent-based modelling and its analytics as Spark DataFrames."""
