"""Column functions and small pure functions of the graph."""
