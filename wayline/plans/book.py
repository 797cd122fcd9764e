"""Where query modules enter what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.fixtures import Views, with_views


class Book:
    def __init__(self) -> None:
        self.runs: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}
        self.bodies: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Enter a function of views as query ``name``; ``sql``: the same rows in plain SQL over the views in braces."""

        def enter(f: Callable[[Views], DataFrame]) -> Callable:
            self.runs[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                self.sql[name], self.bodies[name] = with_views(sql), sql
            return f

        return enter
