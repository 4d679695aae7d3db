"""Single-page algorithms whose state no expression holds; operators run them grouped by page."""
