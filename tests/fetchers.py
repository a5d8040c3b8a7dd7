"""Fetch functions for the connector tests; imported by the executors."""

from attestor.sources.connectors import HttpError


def answer(connector: str, request: str) -> str:
    if connector == "broken":
        raise HttpError(404)
    return '{"results": [{"id": "https://openalex.org/W1", "display_name": "A Title", "doi": "https://doi.org/10.1/X", "publication_year": 2024, "authorships": [{"author": {"display_name": "Ann"}}]}]}'
