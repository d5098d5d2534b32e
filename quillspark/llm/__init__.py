"""Training-data operators: ten corpus-scale steps that nothing else in the library imports."""
