"""Pure term parsing and rendering, and formatting as Column functions."""
