"""Scalar column functions built from JVM-side expressions."""
