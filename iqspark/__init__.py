"""Spark jobs for multi-tone IQ readout recordings."""
