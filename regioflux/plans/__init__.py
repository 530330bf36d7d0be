"""End-to-end analyses composed from the operators. Each returns named, lazy DataFrames."""
