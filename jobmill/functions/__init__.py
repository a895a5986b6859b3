"""Column functions: text, URLs, salaries, places, dictionaries."""
