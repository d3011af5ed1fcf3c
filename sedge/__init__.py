"""sedge: document-corpus analytics written as ordinary Spark DataFrame code."""
