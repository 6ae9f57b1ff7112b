"""Parameter files: ``name: value`` lines, with included files and values that stand for others."""

from __future__ import annotations

from collections.abc import Callable


def parse(text: str, load: Callable[[str], str] | None = None, depth: int = 0) -> dict[str, str]:
    """Names (without the colon) and values of a parameter file.

    Lines that begin with # and what follows a # are comments. ``+++ file`` includes another file, read by
    ``load``. A name of capital letters is a macro: where a later value holds it, its own value stands instead.
    A name that comes twice, one without a colon and an include without end are refused.
    """
    if depth > 100:
        raise ValueError("files include each other without end")
    found: dict[str, str] = {}
    for line in text.splitlines():
        name, _, rest = line.strip().partition(" ") if not line.strip().count("\t") else line.strip().replace("\t", " ").partition(" ")
        rest = rest.split("#")[0].strip()
        if not name or name.startswith("#"):
            continue
        if name == "+++":
            if load is None:
                raise ValueError(f"{rest} is included, but there is no way to read it")
            more = parse(load(rest), load, depth + 1)
        elif name.endswith(":"):
            more = {name[:-1]: rest}
        else:
            raise ValueError(f"{name} is no parameter: the colon is missing")
        if again := found.keys() & more.keys():
            raise ValueError(f"given twice: {', '.join(sorted(again))}")
        found |= more
    if depth:
        return found
    macros = {k: v for k, v in found.items() if k.isupper()}
    for name in found:
        for macro, value in sorted(macros.items(), key=lambda x: -len(x[0])):
            if name != macro:
                found[name] = found[name].replace(macro, value)
    return found


def read(spark, path: str) -> dict[str, str]:
    """The parameters of a file in any store that Spark reads."""
    return parse(_text(spark, path), lambda p: _text(spark, p))


def _text(spark, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def number(parameters: dict[str, str], name: str, default: float) -> float:
    return float(parameters.get(name, default))


def flag(parameters: dict[str, str], name: str, default: bool = False) -> bool:
    """YES and NO in any case, or a number; other words are refused."""
    value = parameters.get(name)
    if value is None:
        return default
    if value.upper() in ("YES", "NO"):
        return value.upper() == "YES"
    return float(value) != 0
