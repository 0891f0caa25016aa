"""Options of a run, and the command line that states them."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """``level`` 1 to 9 sets the effort, ``iterations`` overrides the parse passes, ``twice`` adds whole rounds.

    ``strict`` changes no hidden pixels, looks into no archive entries and refuses gzip members whose extra fields a
    rewrite would drop.  It is the default here: a rewrite must not lose anything.
    """

    level: int = 3
    iterations: int | None = None
    twice: int = 0
    strip: bool = False
    progressive: bool = False
    autorotate: int = 0
    recurse: bool = False
    zip: bool = False
    gzip: bool = False
    quiet: bool = False
    help: bool = False
    keep: bool = False
    png: bool = True
    jpeg: bool = True
    strict: bool = True
    reuse: bool = False
    all_filters: bool = False
    all_filters_brute: bool = False
    all_filters_cheap: bool = False
    palette_sort: int = 0
    mt_deflate: int = 0
    mt_file: int = 0
    arithmetic: bool = False


#: Passes of the shortest-path parse, and whether small blocks are split, by level.
PRESETS: dict[int, dict[str, int]] = {n: {"level": n, "passes": p, "least_split": s} for n, p, s in ((1, 0, 0), (2, 1, 2000), (3, 1, 2000), (4, 2, 2000), (5, 3, 2000), (6, 8, 1300), (7, 13, 1000), (8, 40, 800), (9, 60, 800))}

_FLAGS = {
    "-strip": {"strip": True},
    "-progressive": {"progressive": True},
    "-autorotate": {"autorotate": 2},
    "-autorotate=force": {"autorotate": 1},
    "-recurse": {"recurse": True},
    "-zip": {"zip": True, "gzip": True},
    "-gzip": {"gzip": True},
    "-quiet": {"quiet": True},
    "-help": {"help": True},
    "-keep": {"keep": True},
    "--disable-png": {"png": False},
    "--disable-jpg": {"jpeg": False},
    "--disable-jpeg": {"jpeg": False},
    "--strict": {"strict": True},
    "--reuse": {"reuse": True},
    "--allfilters": {"all_filters": True},
    "--allfilters-b": {"all_filters": True, "all_filters_brute": True},
    "--allfilters-c": {"all_filters": True, "all_filters_cheap": True},
    "--arithmetic": {"arithmetic": True},
}


def level_options(number: int) -> dict[str, int]:
    """0 counts as 1; above 9 the level is 9 with that many iterations; from 10000 on, thousands are extra rounds."""
    twice, number = divmod(number, 10_000)
    out = {"level": min(max(number, 1), 9), "twice": twice}
    return out | ({"iterations": number} if number > 9 else {})


def parse_args(argv: list[str]) -> tuple[Options, list[str], list[str]]:
    """(options, inputs, messages).  Unlike the library default, a command line is not strict unless it says so."""
    options, inputs, messages = Options(strict=False), [], []
    for arg in argv:
        name, _, value = arg.partition("=")
        if not arg.startswith("-"):
            inputs.append(arg)
        elif arg[1:].isdigit():
            options = replace(options, **level_options(int(arg[1:])))
        elif arg in _FLAGS:
            options = replace(options, **_FLAGS[arg])
        elif name == "--pal_sort" and value.isdigit():
            options = replace(options, palette_sort=min(int(value), 120))
        elif name in ("--mt-deflate", "--mt-file") and (not value or value.isdigit()):
            options = replace(options, **{name[2:].replace("-", "_"): int(value or os.cpu_count() or 1)})
        else:
            # An abbreviation stands for the first flag that begins with it, a bare dash for the first of all.
            match = next((f for f in _FLAGS if not arg.startswith("--") and f.startswith(arg)), None)
            if match:
                options = replace(options, **_FLAGS[match])
            else:
                messages.append(f"unknown flag: {arg}")
    if options.autorotate and not options.strip:
        messages.append("-autorotate needs -strip")
    if options.reuse:
        options = replace(options, all_filters=False, level=max(options.level, 2))
    return options, inputs, messages
