"""sources of plexigrid."""
