"""Analytics over crawled pages, documents, claims, events and vectors, as Spark plans."""
