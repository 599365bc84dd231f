"""Text renderings of graphs and tables, and table writers."""
