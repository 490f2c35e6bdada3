"""Training-data operators over document and embedding tables; nothing else in the library imports this subpackage."""
