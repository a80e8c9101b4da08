"""DataFrame-to-DataFrame operators over nodes, edges, sessions and events."""
