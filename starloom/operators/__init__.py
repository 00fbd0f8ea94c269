"""starloom.operators"""
