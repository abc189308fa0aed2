"""From a pipeline's text to Spark plans."""
