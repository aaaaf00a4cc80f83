"""Search-result, page and event-log analytics as Spark DataFrame plans."""
