"""starloom.functions"""
