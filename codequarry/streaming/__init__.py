"""Session operators as streams."""
