"""The llm subpackage."""
