"""The sources subpackage."""
