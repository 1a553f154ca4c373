"""Tailing source and watch pipeline."""
