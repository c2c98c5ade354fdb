"""Live property graphs as Spark DataFrames: selection, links, folds, groups, views and feeds."""
