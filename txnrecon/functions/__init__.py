"""Scalar building blocks: every function here maps Columns to a Column."""
