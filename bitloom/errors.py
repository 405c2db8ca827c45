"""Error codes of the codec, and how a decode reports them."""

from __future__ import annotations

#: The codes that callers match on.
CODES = ("INCOMPLETE_DATA", "INVALID_VALUE", "INVALID_ENCODING", "INVALID_UTF8", "INVALID_VARIANT", "ALIGNMENT_REQUIRED", "OUT_OF_BOUNDS", "STACK_OVERFLOW", "SCHEMA_MISMATCH", "CIRCULAR_REFERENCE")


class CodecError(ValueError):
    """A message that doesn't fit its schema: one of CODES, the byte position, and what was done."""

    def __init__(self, code: str, text: str, position: int | None = None, context: str = ""):
        super().__init__(f"{code}: {text}" + (f" at byte {position}" if position is not None else "") + (f" in {context}" if context else ""))
        self.code, self.text, self.position, self.context = code, text, position, context


class SchemaError(ValueError):
    """A schema that breaks one or more rules."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems
