"""Column functions on titles, dates, citations and links."""
