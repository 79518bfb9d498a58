"""Plans built from the operators: the layer build and the registered queries."""
