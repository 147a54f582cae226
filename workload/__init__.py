"""The library's operators run over the test tables, each with an independent SQL text."""
