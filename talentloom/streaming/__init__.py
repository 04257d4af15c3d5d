"""The streaming subpackage."""
