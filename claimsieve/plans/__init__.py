"""Jobs that chain operators: feature build, model search, whole run."""
