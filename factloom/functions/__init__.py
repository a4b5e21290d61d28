"""Column functions: text, numbers, dates, URLs, JSON and ids."""
