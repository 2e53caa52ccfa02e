"""Error codes. Every strict function returns a value or one of these names, never a silent null."""

from __future__ import annotations

# The names of the codes, in the order of their numbers (0 is success).
CODES = (
    "SUCCESS", "CAPACITY", "MEMALLOC", "TAPE_ERROR", "DEPTH_ERROR", "STRING_ERROR", "T_ATOM_ERROR", "F_ATOM_ERROR", "N_ATOM_ERROR", "NUMBER_ERROR", "BIGINT_ERROR",
    "UTF8_ERROR", "UNINITIALIZED", "EMPTY", "UNESCAPED_CHARS", "UNCLOSED_STRING", "UNSUPPORTED_ARCHITECTURE", "INCORRECT_TYPE", "NUMBER_OUT_OF_RANGE",
    "INDEX_OUT_OF_BOUNDS", "NO_SUCH_FIELD", "IO_ERROR", "INVALID_JSON_POINTER", "INVALID_URI_FRAGMENT", "UNEXPECTED_ERROR", "PARSER_IN_USE", "OUT_OF_ORDER_ITERATION",
    "INSUFFICIENT_PADDING", "INCOMPLETE_ARRAY_OR_OBJECT", "SCALAR_DOCUMENT_AS_VALUE", "OUT_OF_BOUNDS", "TRAILING_CONTENT", "OUT_OF_CAPACITY",
)
NUMBER = {name: i for i, name in enumerate(CODES)}

#: What to tell a reader about the codes that this engine raises.
SAID = {
    "CAPACITY": "the document is larger than the reader allows",
    "TAPE_ERROR": "the document is not well-formed",
    "DEPTH_ERROR": "the document is nested too deeply",
    "STRING_ERROR": "a string holds a bad escape",
    "T_ATOM_ERROR": "a value that begins with t is not true",
    "F_ATOM_ERROR": "a value that begins with f is not false",
    "N_ATOM_ERROR": "a value that begins with n is not null",
    "NUMBER_ERROR": "a number is malformed or too large for a double",
    "BIGINT_ERROR": "an integer doesn't fit 64 bits",
    "UTF8_ERROR": "the input is not UTF-8",
    "EMPTY": "there is no document",
    "UNESCAPED_CHARS": "a string holds a control character",
    "UNCLOSED_STRING": "a string has no end",
    "INCORRECT_TYPE": "the value has another type",
    "NUMBER_OUT_OF_RANGE": "the number doesn't fit the type that was asked for",
    "INDEX_OUT_OF_BOUNDS": "the array is shorter",
    "NO_SUCH_FIELD": "the object has no such key",
    "IO_ERROR": "the input can't be read",
    "INVALID_JSON_POINTER": "the pointer or path is malformed",
    "INCOMPLETE_ARRAY_OR_OBJECT": "the document ends inside an array or object",
    "SCALAR_DOCUMENT_AS_VALUE": "the document is a scalar",
    "TRAILING_CONTENT": "something follows the document",
}


class JsonError(ValueError):
    """A code, and where in the text (in code points) it was found, if that is known."""

    def __init__(self, code: str, at: int | None = None):
        super().__init__(f"{code}: {SAID.get(code, code.lower().replace('_', ' '))}")
        self.code, self.at = code, at

    def __reduce__(self):
        return JsonError, (self.code, self.at)


def message(code: str) -> str:
    """A sentence about a code."""
    if code not in NUMBER:
        raise KeyError(code)
    return "no error" if code == "SUCCESS" else SAID.get(code, code.lower().replace("_", " "))
