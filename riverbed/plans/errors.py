"""Rejections, with the code and status that a client sees."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that can't be registered, or an event that can't be taken."""

    def __init__(self, code: str, status: int = 400, **details: object):
        super().__init__(f"{code} {details}" if details else code)
        self.code, self.status, self.details = code, status, details

    def body(self) -> dict[str, object]:
        return {"code": self.code, **self.details}
