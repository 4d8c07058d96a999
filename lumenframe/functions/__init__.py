"""Functions over single values: pixel planes, colours, feature names and distributions."""
