"""Column functions: strings, URLs, JSON, statistics."""
