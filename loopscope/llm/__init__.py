"""Training-data operators: mixing, search, language, fingerprints, joins, filters, classifiers, token ids.

Nothing outside this subpackage imports it.
"""
