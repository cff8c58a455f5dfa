"""DataFrame operators: graph walks, text, ranges, diffs, writes and delivery."""
