"""Operators that prepare training data from captions, study pairs, posts and a tool index."""
