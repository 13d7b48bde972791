"""Operators over DataFrames that several plans use."""
