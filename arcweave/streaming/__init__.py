"""Nothing here: graphs and texts are bounded tables."""
