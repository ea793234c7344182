"""fixlattice: closure-style analytics (lattices, logs, deltas, graphs, deduction) on PySpark DataFrames."""
