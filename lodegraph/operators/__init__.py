"""DataFrame operators over nodes, edges, facts and text."""
