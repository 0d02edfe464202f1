"""Entry names: masks, validity, flags, paths and widths, as expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NAME_BYTES = 65_535
UTF8_FLAG = 0x0800
#: POSIX character classes as ASCII ranges of a bracket.
CLASSES = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": r"\x20\x09", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"\x21-\x7e", "lower": "a-z", "print": r"\x20-\x7e", "punct": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e", "space": r"\x20\x09-\x0d", "upper": "A-Z", "xdigit": "0-9A-Fa-f"}


def _bracket(mask: str, i: int) -> tuple[str, int, bool] | None:
    """The inside of a bracket that opens before i, the place after it, and whether it is negated; None if it does not close."""
    negated = mask[i : i + 1] in ("!", "^")
    i += negated
    parts, first = [], True
    while i < len(mask) and (first or mask[i] != "]"):
        named = re.match(r"\[:([a-z]+):\]", mask[i:])
        if named and named[1] in CLASSES:
            parts.append(CLASSES[named[1]])
            i += len(named[0])
        else:
            if mask[i] == "\\" and i + 1 < len(mask):
                i += 1
            low = mask[i]
            if mask[i + 1 : i + 2] == "-" and mask[i + 2 : i + 3] not in ("", "]"):
                high = mask[i + 2]
                if low <= high:
                    parts.append(f"{_quoted(low)}-{_quoted(high)}")
                i += 3
            else:
                parts.append(_quoted(low))
                i += 1
        first = False
    return ("".join(parts), i + 1, negated) if i < len(mask) else None


def _quoted(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}"


def mask_regex(mask: str) -> str:
    """A regular expression (Java and RE2 alike, without look-around) of a file mask.

    Wildcards do not match "/", nor a "." that starts a name or, in a mask with
    "/", a component; a backslash takes the next character as it is.
    """
    out, i, leading = [], 0, True
    while i < len(mask):
        c = mask[i]
        i += 1
        plain = "[^./]" if leading else "[^/]"
        if c == "*":
            while mask[i : i + 1] == "*":
                i += 1
            out.append("(?:[^./][^/]*)?" if leading else "[^/]*")
            # a star at a component's start may match nothing: what follows it then leads
            if leading and i < len(mask) and mask[i] in "?[":
                rest = mask[i:]
                return "".join(out[:-1]) + "(?:" + "[^./][^/]*" + mask_tail(rest, False) + "|" + mask_tail(rest, True) + ")"
        elif c == "?":
            out.append(plain)
        elif c == "[" and (found := _bracket(mask, i)):
            inside, i, negated = found
            if negated:
                out.append(f"[^/{'.' if leading else ''}{inside}]")
            else:
                # the bracket without "/" and, where it leads, without "."
                out.append(_without(inside, "/." if leading else "/"))
        elif c == "\\" and i < len(mask):
            out.append(_quoted(mask[i]))
            i += 1
        else:
            out.append("/" if c == "/" else _quoted(c))
        leading = c == "/"
    return "".join(out)


def mask_tail(mask: str, leading: bool) -> str:
    """mask_regex of a mask's rest, which starts a component or not."""
    return mask_regex(mask) if leading else mask_regex("x" + mask)[1:]


def _without(inside: str, banned: str) -> str:
    """A character class less some ASCII characters, spelled out."""
    test = re.compile(f"[{inside}]") if inside else None
    chars = "".join(_quoted(chr(c)) for c in range(1, 128) if chr(c) not in banned and test and test.match(chr(c)))
    wide = "".join(re.findall(r"[^\x00-\x7f](?:-[^\x00-\x7f])?", inside))
    return f"[{chars}{wide}]" if chars or wide else r"[^\s\S]"


def mask_matches(path: Column, mask: str) -> Column:
    """Whether a mask matches: the whole relative path if it has a "/", else the last component."""
    target = path if "/" in mask else basename(path)
    return target.rlike(f"^(?:{mask_regex(mask)})$") & ~target.contains("\n")


def matches_any(path: Column, masks: Sequence[str]) -> Column:
    """Any of the masks; no masks accept all."""
    return reduce(lambda a, b: a | b, (mask_matches(path, m) for m in masks)) if masks else F.lit(True)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == ".", name).otherwise(F.concat_ws("/", directory, name))


def valid_name(name: Column) -> Column:
    """Not empty, not absolute, without empty components (one trailing "/" apart) and without ".."."""
    body = F.regexp_replace(name, "/$", "")
    parts = F.split(body, "/")
    return (F.length(body) > 0) & ~F.exists(parts, lambda p: (p == "") | (p == ".."))


def name_flags(raw: Column) -> Column:
    """The UTF-8 flag of a raw (binary) name, if it is strict UTF-8."""
    return F.when(F.call_function("is_valid_utf8", raw.cast("string")), F.lit(UTF8_FLAG)).otherwise(F.lit(0))


def admissible(name: Column, size: Column) -> Column:
    return valid_name(name) & (F.octet_length(name) <= MOST_NAME_BYTES) & (size <= 2**32 - 1)


def archive_name(text: str) -> str:
    """The archive's name with its extension: ".zip" if there is none, "zip" after a trailing dot."""
    base = text.rpartition("/")[2]
    if base in ("", ".", ".."):
        raise ValueError(f"not an archive name: {text}")
    dot = base.rfind(".")
    if dot <= 0:
        return text + ".zip"
    return text + "zip" if dot == len(base) - 1 else text


#: Code points of two terminal columns.
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"


def display_width(name: Column) -> Column:
    """Terminal columns: two for wide characters, none for combining marks."""
    return F.length(name) + F.length(name) - F.length(F.regexp_replace(name, WIDE, "")) - (F.length(name) - F.length(F.regexp_replace(name, r"[\p{Mn}\p{Me}]", "")))
