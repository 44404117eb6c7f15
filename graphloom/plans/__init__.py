"""Plan-level helpers shared by the operators: lineage cuts, supersteps, components."""
