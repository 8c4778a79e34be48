"""Operators on DataFrames: reduction, features, tree, rules, report, importance, split search."""
