"""Files, stored documents and written tables."""
