"""Query keys to paths into an event."""

from __future__ import annotations

from .errors import QueryError

Path = tuple[str, ...]


def parse_key(key: str) -> Path:
    """``foo`` is data.foo taken literally, ``/a/b`` a JSON Pointer under data, ``../a`` one from the event's root."""
    if key.startswith("../"):
        root, pointer = (), key[3:]
    elif key.startswith("/"):
        root, pointer = ("data",), key[1:]
    else:
        return ("data", key)
    return (*root, *(unescape(s, key) for s in pointer.split("/")))


def unescape(segment: str, key: str) -> str:
    """``~0`` is ``~`` and ``~1`` is ``/``; any other use of ``~`` is an error."""
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        if c == "~":
            nxt = segment[i + 1 : i + 2]
            if nxt not in ("0", "1"):
                raise QueryError("invalid-json-pointer", key=key)
            c = "~" if nxt == "0" else "/"
            i += 1
        out.append(c)
        i += 1
    return "".join(out)


def offset_of(segment: str) -> int | None:
    """The array offset that a segment names, in canonical decimal only, or None."""
    if segment.isascii() and segment.isdigit() and (segment == "0" or segment[0] != "0") and int(segment) < 2**31:
        return int(segment)
    return None


def path_text(path: Path) -> str:
    """A path as one string, reversible and unambiguous."""
    return "/".join(s.replace("~", "~0").replace("/", "~1") for s in path)
