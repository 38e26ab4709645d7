"""Operators for large training-text pipelines.

One module for each operator; ``queries`` registers them for the driver.
Nothing outside this folder imports it.
"""
