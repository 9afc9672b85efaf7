"""gridweave: Spark-native analytics for electricity-network models.

Operators are plain ``DataFrame -> DataFrame`` functions; nothing is executed
until the caller asks for an action, except in the few fixpoint loops, which
say so in their docstrings.
"""
