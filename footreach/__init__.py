"""Walking reachability and facility coverage as Spark DataFrame transformations."""
