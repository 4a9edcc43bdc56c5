"""End-to-end plans: feature tables, model pipelines, and the query catalog."""
