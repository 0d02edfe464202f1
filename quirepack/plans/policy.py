"""Compression policy: settings catalogue, level presets, size literals, INI sections and command-line options.

All of it runs on the driver; presets() and catalogue() give the same tables as
DataFrames for joins.
"""

from __future__ import annotations

import os
import re
import shutil
import sys
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

DEFAULT_LEVEL = 7
ENGINES = ("fast", "ect", "turtle")
#: The shift of a size that says "never".
OFF = None
INT32 = (-(2**31), 2**31 - 1)

#: Name, least and greatest value of each block-splitting encoder setting, and its value at levels 7, 8 and 9.
ECT_SETTINGS = [
    ("numiterations", 1, 1000, (3, 12, 600)),
    ("filter_style", 0, 3, (1, 1, 3)),
    ("skipdynamic", 0, 1000000, (80, 80, 80)),
    ("trystatic", 0, 1000000, (0, 300, 3000)),
    ("noblocksplit", 0, 1000000, (1000, 1000, 1734)),
    ("noblocksplitlz", 0, 1000000, (2250, 3300, 54)),
    ("num", 1, 64, (9, 9, 8)),
    ("searchext", 0, 2, (1, 1, 2)),
    ("reuse_costmodel", 0, 1, (1, 1, 0)),
    ("useCache", 0, 1, (1, 1, 1)),
    ("multithreading", 0, 0, (0, 0, 0)),
    ("isPNG", 0, 0, (0, 0, 0)),
    ("replaceCodes", 0, 100000, (1001, 1001, 5963)),
    ("twice", 0, 1, (1, 1, 1)),
    ("ultra", 0, 3, (1, 1, 3)),
    ("greed", 0, 258, (48, 48, 182)),
    ("entropysplit", 0, 1, (1, 1, 0)),
    ("advanced", 0, 1, (1, 1, 1)),
]
#: Name, least and greatest value (None: any 32-bit number; checked across fields), value at level 9.
TURTLE_SETTINGS = [
    ("i_compression_level", 1, 9, 9),
    ("i_maximum_block_size", 1, 1000000, 1000000),
    ("i_maximum_subblocks", 1, 512, 512),
    ("i_max_block_splitter_iterations", 1, 1000, 30),
    ("i_max_internal_block_splitter_iterations", 1, 1000, 100),
    ("i_block_splitter_num_points", 1, None, 31),
    ("i_block_splitter_center_dist", 1, None, 8),
    ("i_block_splitter_min_range_for_points", 1, None, 1024),
    ("b_block_splitter_push_split", 0, 1, 1),
    ("i_min_start_fp", -32, 32, -6),
    ("i_max_start_fp", -32, 32, 5),
    ("i_num_start_fp", 2, None, 16),
    ("i_verbose", 0, 5, 0),
]
#: What each setting does, for the full help.
MEANINGS = {
    "numiterations": "how many times matches are chosen anew with the costs of the last round",
    "filter_style": "kept for old settings files; has no effect on plain data",
    "skipdynamic": "blocks of up to so many bytes get no code tables of their own",
    "trystatic": "blocks of fewer symbols are also tried with the standard tables; 0: never",
    "noblocksplit": "inputs of fewer bytes stay one block",
    "noblocksplitlz": "blocks of fewer symbols are not cut",
    "num": "places tried in each round of the search for a cut",
    "searchext": "how thoroughly the table header is searched, 0 least",
    "reuse_costmodel": "1: a round begins with the costs of the one before",
    "useCache": "1: matches found once are remembered; takes memory, saves time",
    "multithreading": "threads inside the encoder; must be 0",
    "isPNG": "tuning for images; must be 0",
    "replaceCodes": "effort spent on writing short matches as plain bytes where that is smaller",
    "twice": "1: cuts are searched a second time",
    "ultra": "further refinement of the costs, 0 none",
    "greed": "matches of this length or more are taken at once",
    "entropysplit": "1: cuts are rated by entropy; 0: by lengths of codes",
    "advanced": "1: tables and block headers are optimised further",
    "i_compression_level": "effort; from 8 on with additional checks",
    "i_maximum_block_size": "bytes of input that are worked on at a time",
    "i_maximum_subblocks": "blocks that such a part may be cut into",
    "i_max_block_splitter_iterations": "rounds that refine the cuts",
    "i_max_internal_block_splitter_iterations": "cuts and joins tried in each of them",
    "i_block_splitter_num_points": "places sampled in the coarse search for a cut",
    "i_block_splitter_center_dist": "how far around the best of them the next search goes",
    "i_block_splitter_min_range_for_points": "shorter ranges are searched place by place",
    "b_block_splitter_push_split": "1: where nothing helps, one more cut is forced and kept if smaller",
    "i_min_start_fp": "the least precision that costs start with",
    "i_max_start_fp": "the greatest precision that costs start with",
    "i_num_start_fp": "how many precisions between these are tried",
    "i_verbose": "diagnostics, 0 none",
}
#: Effort of the fast encoder at levels 1 to 6.
FAST_LEVELS = (1, 2, 3, 5, 6, 8)
ZLIB_AFTER = 64 << 20
#: Bytes of the units of a size literal.
UNITS = {"": 1, "B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}

_ECT = {name: (low, high) for name, low, high, _ in ECT_SETTINGS}
_TURTLE = {name: (low, high) for name, low, high, _ in TURTLE_SETTINGS}


class PolicyError(ValueError):
    """A setting, section or option that is not valid."""


@dataclass(frozen=True)
class Policy:
    """What is tried for an entry: encoders with their settings, and from which size on zlib streams it instead (None: never)."""

    engines: frozenset[str] = frozenset()
    fast_level: int = 1
    zlib_after: int | None = ZLIB_AFTER
    zlib_level: int = 9
    ect: tuple[tuple[str, int], ...] = ()
    turtle: tuple[tuple[str, int], ...] = ()
    recursive: bool = False

    def check(self) -> Policy:
        if self.zlib_after != 0 and not self.engines:
            raise PolicyError("no compressor is selected")
        if "turtle" in self.engines:
            own = dict(self.turtle)
            for name, value in own.items():
                low, high = _TURTLE[name]
                if value < low or high is not None and value > high:
                    raise PolicyError(f"{name} is out of range")
            if own["i_block_splitter_center_dist"] > own["i_block_splitter_num_points"] or own["i_min_start_fp"] > own["i_max_start_fp"]:
                raise PolicyError("turtle settings contradict each other")
        return self


@dataclass
class Request:
    """A parsed command line."""

    archive: str
    inputs: list[str]
    level: int
    policy: Policy
    #: Inputs from this place on are names even if they start with "@".
    literal_from: int = field(default=1 << 30)


def parse_size(text: str) -> int | None:
    """"off" is None; digits with B, KiB, MiB, GiB or nothing."""
    if text == "off":
        return OFF
    found = re.fullmatch(r"([0-9]+)([A-Za-z]*)", text)
    if not found or found[2] not in UNITS:
        raise PolicyError(f"not a size: {text}")
    value = int(found[1]) * UNITS[found[2]]
    if value > 2**64 - 1:
        raise PolicyError(f"too large a size: {text}")
    return value


def parse_int(text: str) -> int:
    if not re.fullmatch(r"\s*[+-]?[0-9]+", text) or not INT32[0] <= int(text) <= INT32[1]:
        raise PolicyError(f"not a number: {text}")
    return int(text)


def preset(level: int) -> Policy:
    """The compiled policy of a level."""
    if not 1 <= level <= 9:
        raise PolicyError(f"no level {level}")
    row = max(level - 7, 0)
    ect = tuple((name, values[row]) for name, _, _, values in ECT_SETTINGS)
    turtle = tuple((name, value) for name, _, _, value in TURTLE_SETTINGS)
    fast = FAST_LEVELS[min(level, 6) - 1]
    if level <= 6:
        return Policy(frozenset({"fast"}), fast, ZLIB_AFTER, fast, ect, turtle)
    return Policy(frozenset({"ect", "turtle"} if level == 9 else {"ect"}), fast, OFF, level, ect, turtle)


def known_option(option: str) -> bool:
    head, _, name = option.partition("_")
    if option in ("--zlib_after", "--zlib_level", "--libdeflate_level"):
        return True
    return (head == "--zopfli" and name in _ECT) or (head == "--turtledeflate" and name in _TURTLE)


def apply_option(policy: Policy, option: str, value: str) -> Policy:
    """The policy with one setting changed; a setting of an encoder makes it take part."""
    if option == "--zlib_after":
        return replace(policy, zlib_after=parse_size(value))
    if not known_option(option):
        raise PolicyError(f"unknown setting {option}")
    number = parse_int(value)

    def within(low: int, high: int | None) -> int:
        if number < low or high is not None and number > high:
            raise PolicyError(f"invalid value for {option}")
        return number

    if option == "--zlib_level":
        return replace(policy, zlib_level=within(1, 9))
    if option == "--libdeflate_level":
        return replace(policy, fast_level=within(1, 12), engines=policy.engines | {"fast"})
    head, _, name = option.partition("_")
    if head == "--zopfli":
        within(*_ECT[name])
        return replace(policy, ect=tuple((k, number if k == name else v) for k, v in policy.ect), engines=policy.engines | {"ect"})
    if name.startswith("b_"):
        within(0, 1)
    return replace(policy, turtle=tuple((k, number if k == name else v) for k, v in policy.turtle), engines=policy.engines | {"turtle"})


def read_section(text: str, level: int, policy: Policy, path: str = "settings") -> Policy:
    """The policy after the [level] section of an INI text. Encoders are those that the section names; other values stay. Other sections are not looked into."""
    policy = replace(policy, engines=frozenset())
    active = found = False
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if line.startswith("["):
            active = line == f"[{level}]"
            if active and found:
                raise PolicyError(f"invalid setting in {path}:{number}")
            found = found or active
        elif active and line and line[0] not in "#;":
            option, _, value = line.partition(" ") if " " in line else line.partition("\t")
            value = value.strip()
            try:
                if option == "-r" and not value:
                    policy = replace(policy, recursive=True)
                elif not value or len(value.split()) != 1 or not known_option(option):
                    raise PolicyError(line)
                else:
                    policy = apply_option(policy, option, value)
            except PolicyError:
                raise PolicyError(f"invalid setting in {path}:{number}") from None
    if not found:
        raise PolicyError(f"missing section [{level}] in {path}")
    return policy


def default_ini() -> str:
    """An INI text that gives the compiled presets."""
    sections = []
    for level in range(1, 10):
        own = preset(level)
        lines = [f"[{level}]"]
        if "fast" in own.engines:
            lines.append(f"--libdeflate_level {own.fast_level}")
        if "ect" in own.engines:
            lines += [f"--zopfli_{k} {v}" for k, v in own.ect]
        if "turtle" in own.engines:
            lines += [f"--turtledeflate_{k} {v}" for k, v in own.turtle]
        lines += [f"--zlib_after {'off' if own.zlib_after is None else own.zlib_after}", f"--zlib_level {own.zlib_level}"]
        sections.append("\n".join(lines) + "\n")
    return "\n".join(sections)


def write_default_ini(path: str) -> bool:
    """Writes the default INI unless the file is there; it appears whole or not at all."""
    temporary = f"{path}.tmp.{os.getpid()}"
    with open(temporary, "x", encoding="utf-8") as out:
        out.write(default_ini())
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(temporary, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(temporary)


def beside_program(name: str) -> str | None:
    """A file's path beside the running program, which is looked up in PATH if it was called by name alone; None where it is not known."""
    program = sys.argv[0] if sys.argv and sys.argv[0] else ""
    found = program if os.sep in program else shutil.which(program) if program else None
    return os.path.join(os.path.dirname(os.path.abspath(found)), name) if found else None


def load(level: int, ini: str | None = None, search: tuple[str, ...] = (), created: str | None = None) -> Policy:
    """The level's policy: from the named INI (which must be there), else the first of search that is, else the created one, else compiled.

    created: where a default INI is written if it is not there; where that fails, a warning is given.
    """
    policy = preset(level)
    if created and not ini and not any(map(os.path.exists, search)):
        try:
            if not os.path.exists(created):
                write_default_ini(created)
            search = (*search, created)
        except OSError as e:
            warnings.warn(f"cannot write {created}, compiled settings are used: {e}", stacklevel=2)
    for path in [ini] if ini else [p for p in search if os.path.exists(p)]:
        try:
            with open(path, encoding="utf-8") as f:
                return read_section(f.read(), level, policy, path)
        except OSError as e:
            raise PolicyError(f"cannot read {path}: {e}") from e
    return policy


HELP = """Usage: python -m quirepack [options] <archive[.zip]> [input ...]

  -1 ... -9    Compression level (default: -7).
  -r           Search directories recursively.
  -h, --help   This help.
  --full-help  This help and the compression settings.
  --           All that follows are input names.

An input is a file, a directory (with -r) or @mask; several masks may be given.
Without inputs, @* is taken. An archive name without extension gets .zip.
"""


def full_help() -> str:
    lines = ["", "Settings, in the [1] ... [9] section of the level in an INI file or on the command line, which comes last.", "An encoder takes part if one of its settings is given; the smallest result is kept."]
    lines += ["  --libdeflate_level N (1..12): effort of the fast encoder", "  --zlib_after SIZE (off, or bytes with B, KiB, MiB, GiB): inputs of this size and more go to zlib alone", "  --zlib_level N (1..9): zlib's effort"]
    lines += [f"  --zopfli_{name} N ({low}..{high}): {MEANINGS[name]}" for name, low, high, _ in ECT_SETTINGS]
    lines += [f"  --turtledeflate_{name} N ({low}..{'' if high is None else high}): {MEANINGS[name]}" for name, low, high, _ in TURTLE_SETTINGS]
    return HELP + "\n".join(lines) + "\n"


def parse_arguments(arguments: list[str], ini: str | None = None, search: tuple[str, ...] = (), created: str | None = None) -> Request | str:
    """The request of a command line, or the help text that it asks for. Options may stand anywhere before --."""
    level, i = DEFAULT_LEVEL, 0
    while i < len(arguments) and arguments[i] != "--":
        one = arguments[i]
        if one in ("-h", "--help"):
            return HELP
        if one == "--full-help":
            return full_help()
        if re.fullmatch("-[1-9]", one):
            level = int(one[1])
        i += 2 if known_option(one) else 1
    policy = load(level, ini, search, created)
    names: list[str] = []
    literal, rest = 1 << 30, iter(arguments)
    for one in rest:
        if literal < 1 << 30:
            names.append(one)
        elif one == "--":
            literal = max(len(names) - 1, 0)
        elif one == "-r":
            policy = replace(policy, recursive=True)
        elif re.fullmatch("-[1-9]", one):
            continue
        elif known_option(one):
            value = next(rest, None)
            try:
                if value is None:
                    raise PolicyError(one)
                policy = apply_option(policy, one, value)
            except PolicyError:
                raise PolicyError(f"invalid value for {one}") from None
        elif one.startswith("-"):
            raise PolicyError(f"unknown option: {one}")
        else:
            names.append(one)
    if not names:
        raise PolicyError("no archive is named")
    return Request(names[0], names[1:], level, policy.check(), literal)


PRESET_SCHEMA = "level int, fast boolean, ect boolean, turtle boolean, fast_level int, zlib_after long, zlib_level int, ect_iterations int"


def presets(spark: SparkSession) -> DataFrame:
    """The nine levels as rows, small enough to broadcast."""
    rows = []
    for level in range(1, 10):
        own = preset(level)
        rows.append((level, "fast" in own.engines, "ect" in own.engines, "turtle" in own.engines, own.fast_level if "fast" in own.engines else None, own.zlib_after, own.zlib_level, dict(own.ect)["numiterations"] if "ect" in own.engines else None))
    return spark.createDataFrame(rows, PRESET_SCHEMA)


def catalogue(spark: SparkSession) -> DataFrame:
    """All settings with their bounds."""
    rows = [("--libdeflate_level", 1, 12), ("--zlib_level", 1, 9)]
    rows += [(f"--zopfli_{name}", low, high) for name, low, high, _ in ECT_SETTINGS]
    rows += [(f"--turtledeflate_{name}", low, high) for name, low, high, _ in TURTLE_SETTINGS]
    return spark.createDataFrame(rows, "setting string, least int, greatest int")
