"""Operators over DataFrames: layers, text metrics, scores, topics, crawl."""
