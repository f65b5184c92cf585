"""Operators for building language-model training data, each a Spark job over ``documents`` or ``pages``.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
