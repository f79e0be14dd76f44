"""docbasin.streaming."""
