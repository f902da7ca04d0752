"""Algorithms: plans that are run round by round."""
