"""Spark jobs for personalised news digests."""
