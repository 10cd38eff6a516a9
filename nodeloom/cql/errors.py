"""Query errors carry a stable code, so that callers can tell them apart."""


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
