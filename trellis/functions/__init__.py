"""Column builders: ``Column -> Column`` functions that stay JVM-side."""
