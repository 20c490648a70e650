"""Operators that prepare text and entity data for training. Nothing outside this subpackage imports it."""
