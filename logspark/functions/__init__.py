"""Column functions: levels, templates, hashes, properties, filters."""
