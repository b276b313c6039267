"""Incremental forms of the mergeable operators (the batch operators' partial states add up)."""
