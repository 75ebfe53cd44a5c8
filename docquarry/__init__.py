"""docquarry: document, fact and retrieval analytics expressed as Spark DataFrame plans."""
