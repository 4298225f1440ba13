"""Readers, derived inputs and keyed table maintenance."""
