"""Training-data operators: ten document operators and their queries.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds the
queries of :mod:`cartolith.llm.queries` when the folder is present.
"""
