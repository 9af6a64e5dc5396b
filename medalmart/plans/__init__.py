"""The layers, composed from the operators."""
