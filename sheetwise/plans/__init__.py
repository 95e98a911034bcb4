"""Formula text to syntax trees, and trees to Spark columns and plans."""
