"""functions of plexigrid."""
