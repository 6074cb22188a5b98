"""Training-data operators over the text tables; nothing else in the library imports this subpackage."""
