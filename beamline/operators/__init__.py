"""Operators over predictions, catalogs, words, boxes and logs; each takes and returns DataFrames."""
