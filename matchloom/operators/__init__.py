"""DataFrame building blocks.

Conventions: inputs are DataFrames with named columns, outputs are lazy DataFrames, every ranking has
a total order, and no operator gathers an unbounded group in one task (see README, "Skew").
"""
