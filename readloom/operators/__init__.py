"""Operators over reads: profiles of streams, ordered runs, and the choice of encodings that follows from them."""
