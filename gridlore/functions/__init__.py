"""Column functions: vectors, grid geometry, geography."""
