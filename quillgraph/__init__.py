"""quillgraph: concept-graph analytics and text processing as Spark plans."""
