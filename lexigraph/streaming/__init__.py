"""Incremental work over shards. The engine has no unbounded streams: every source is a bounded file set."""
