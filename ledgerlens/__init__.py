"""Spark jobs over append-only knowledge logs: state, retrieval, projections, pipelines."""
