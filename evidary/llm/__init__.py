"""Operators for large training-data sets, one module each; ``registry`` lists their queries."""
