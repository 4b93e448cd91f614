"""Spark analytics for large collections of sampled series (spectra are one instance)."""
