"""streaming of quillspark."""
