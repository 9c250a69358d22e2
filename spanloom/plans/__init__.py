"""Named queries over the standard tables."""
