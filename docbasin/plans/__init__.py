"""docbasin.plans."""
