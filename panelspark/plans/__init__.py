"""Panel plans."""
