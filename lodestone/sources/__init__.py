"""Where files come from: folders, and the driver's tables."""
