"""DataFrame operators: projection, edges, merge, versions, profiling, and data repair."""
