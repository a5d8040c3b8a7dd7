"""Compositions: the engine that runs operators over a set of inputs, the registry of operators, stage manifests."""
