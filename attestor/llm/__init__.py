"""Training-data operators: classifiers, near-duplicate search, tokens, packing and personal data.

Nothing else in :mod:`attestor` imports this subpackage, so it can be left out of a deployment.
"""
