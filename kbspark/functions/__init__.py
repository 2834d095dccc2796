"""Column functions over knowledge entries, paths, commits and model replies."""
