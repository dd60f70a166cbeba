"""Readers, writers and the mapping of the test tables onto the retail model."""
