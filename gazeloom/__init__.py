"""Analytics over ordered per-recording observations, expressed as Spark plans."""
