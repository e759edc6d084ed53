"""Row-local column functions: scorers, rewards, logits, text and the normal quantile."""
