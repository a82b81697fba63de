"""Part of quillgraph; see README.md."""
