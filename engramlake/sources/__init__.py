"""Readers, writers and the derivation of domain tables from raw tables."""
