"""Fields, grids, generated inputs and writers."""
