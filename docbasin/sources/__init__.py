"""docbasin.sources."""
