"""Warnings that one operator gives and another one knows."""

#: A record has warnings of its extraction; checks don't repeat it.
HAS_WARNINGS = "extraction gave warnings"
#: The field's name follows. In lower case, as warnings are compared.
REQUIRED_MISSING = "required field without a value: "
