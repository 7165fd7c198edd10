"""Time-stamped KPI analytics on Spark: typed sources, layout-aware melts, validation, temporal links."""
