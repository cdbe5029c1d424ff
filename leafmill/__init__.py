"""Spark jobs that turn fetched pages, feeds, captions and search hits into ordered, attributed documents."""
