"""Whole plans composed of the operators."""
