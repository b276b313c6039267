"""Private inference over Spark tables: bag-of-little-bootstraps intervals, private aggregates, interval search."""
