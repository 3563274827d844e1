"""Whole plans: the binning run and the catalogue of registered queries."""
