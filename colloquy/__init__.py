"""Colloquy: chat-transcript analytics on Spark DataFrames."""
