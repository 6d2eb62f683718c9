"""plans of textloom."""
