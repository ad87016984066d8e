"""DataFrame operators: ``DataFrame -> DataFrame`` functions."""
