"""plans of quillspark."""
