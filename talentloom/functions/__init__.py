"""The functions subpackage."""
