"""docbasin.operators."""
