"""Input views, the code graph with its named questions, and registered queries."""
