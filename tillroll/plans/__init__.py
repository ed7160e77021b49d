"""Query plans: the named sales queries, the metric layer, drill-downs,
forecasts and the dataset registry."""
