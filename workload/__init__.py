"""The queries run over the test tables, with their SQL counterparts."""
