"""docbasin.functions."""
