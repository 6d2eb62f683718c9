"""sources of textloom."""
