"""Training-data operations: ten corpus operators and what they share.

Nothing else in the library imports this subpackage.
"""
