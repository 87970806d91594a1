"""operators of quillspark."""
