"""plexigrid: volumetric label-graph analytics and large-table maintenance on PySpark."""
