"""Application files, images and the sinks of batch results."""
