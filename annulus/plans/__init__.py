"""Plans that put the operators together, and a query for each operator."""
