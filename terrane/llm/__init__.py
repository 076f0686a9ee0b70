"""Training-data operators: the rest of the library never imports this subpackage."""
