"""Schedule, network, demand, path and choice-model operators over DataFrames."""
