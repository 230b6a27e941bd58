"""Readers that turn tables, folders and documents into nodes, edges and facts."""
