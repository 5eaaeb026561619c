"""DataFrame operators: rollups, facts, marts, views, quality and loading."""
