"""Static registries: relations, roles and node kinds."""
