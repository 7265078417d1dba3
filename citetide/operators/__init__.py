"""Distributed building blocks shared by the plans."""
