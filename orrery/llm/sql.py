"""Reference SQL of the llm queries, where SQL can express them.

Parsing, tokenizing, packing and the robust estimate have no SQL; they are
tested against independent parsers, the public tokenizer libraries and brute
force in ``tests/llm``.
"""

SQL: dict[str, str] = {}
