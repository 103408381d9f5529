"""operators of plexigrid."""
