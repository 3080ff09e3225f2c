"""Column functions: text, dates, URLs, titles, HTML."""
