"""The reports: each takes source tables and returns one lazy DataFrame."""
