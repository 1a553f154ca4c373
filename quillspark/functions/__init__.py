"""Scalar column builders; all of them stay in the JVM."""
