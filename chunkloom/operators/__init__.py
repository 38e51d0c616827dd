"""Relational operators on chunks, edges, vectors and trees."""
