"""The query surface: functions over a store that return DataFrames, with the defaults of its two front ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from corpusloom.functions.embedding import query_vector
from corpusloom.operators import reports, search
from corpusloom.store import IndexNotReady, Store


class Api:
    """Search, duplicates, file, repositories and definitions over the store's current version."""

    def __init__(self, store: Store, provider: Callable) -> None:
        self.store, self.provider = store, provider

    def _chunks(self) -> DataFrame:
        try:
            return self.store.read("chunks")
        except AnalysisException as e:
            raise IndexNotReady(str(e)) from e

    def search(self, query: str, top_k: int = 8, max_chars: int = 0, **filters: object) -> DataFrame:
        return search.hybrid_search(self._chunks(), query, query_vector(self.provider, query), top_k, max_chars=max_chars, index=self.store.read("postings"), **filters).orderBy("rk")

    def duplicates(self, **options: object) -> DataFrame:
        return reports.duplicate_clusters(self._chunks(), **options)

    def file(self, project: str, repo: str, path: str, from_line: int | None = None, to_line: int | None = None, max_chars: int = 0) -> DataFrame:
        return reports.file_context(self._chunks(), project, repo, path, from_line, to_line, max_chars)

    def repositories(self) -> DataFrame:
        try:
            states = self.store.read("repo_index_state")
        except IndexNotReady:
            states = None
        return reports.inventory(self._chunks(), states)

    def languages(self) -> DataFrame:
        """Chunks by language."""
        return reports.languages(self._chunks())

    def total(self) -> int:
        """Chunks in the index."""
        return self._chunks().count()

    def definitions(self, name: str, top_k: int = 8, max_chars: int = 0, **filters: object) -> DataFrame:
        return search.find_definitions(self._chunks(), name, top_k=top_k, max_chars=max_chars, index=self.store.read("postings"), **filters)


class Tools(Api):
    """The same for assistants: shorter texts by default."""

    def search_code(self, query: str, top_k: int = 8, max_chars: int = 2500, **filters: object) -> DataFrame:
        return self.search(query, top_k, max_chars, **filters)

    def get_file_context(self, project: str, repo: str, path: str, from_line: int | None = None, to_line: int | None = None, max_chars: int = 6000) -> DataFrame:
        return self.file(project, repo, path, from_line, to_line, max_chars)

    def find_definition(self, name: str, top_k: int = 8, max_chars: int = 2500, **filters: object) -> DataFrame:
        return self.definitions(name, top_k, max_chars, **filters)

    find_duplicates = Api.duplicates
    list_repos = Api.repositories
