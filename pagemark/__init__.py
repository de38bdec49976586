"""Full-text document search and text analytics on PySpark."""
