"""streaming of plexigrid."""
