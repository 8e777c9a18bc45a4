"""Pages as trees: building, content scope, and the extraction of one record a page."""
