"""Column expressions: text, HTML, URL and JSON helpers."""
