"""Sequence-data engine on Spark DataFrames: load, render, tokenise, pack, corrupt, decode and score token sequences."""
