"""Import-graph analytics on Spark: discovery, extraction, resolution, cycles, traces and reports."""
