"""Scalar column functions, all evaluated in the JVM unless a docstring says otherwise."""
