"""starloom.streaming"""
