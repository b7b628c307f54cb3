"""Table-agnostic operators: joins, ranking, regression, filters and value resolution."""
