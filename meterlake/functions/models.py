"""Model name columns: short display names, families and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model families in order of precedence (fixed values).
FAMILIES = ["Opus", "Sonnet", "Haiku"]

# Model aliases of two providers (fixed values).
CODEX_ALIASES = {"gpt-5-codex": "gpt-5"}
OPENCODE_ALIASES = {"gemini-3-pro-high": "gemini-3-pro-preview"}

CODEX_DEFAULT_MODEL = "gpt-5"

_LARGEST_U64 = "18446744073709551615"


def apply_aliases(model: Column, aliases: dict[str, str]) -> Column:
    result = model
    for old, new in aliases.items():
        result = F.when(model == old, F.lit(new)).otherwise(result)
    return result


def family(model: Column) -> Column:
    """Opus, Sonnet or Haiku; null for any other model."""
    lower = F.lower(model)
    result = F.lit(None).cast("string")
    for name in reversed(FAMILIES):
        result = F.when(lower.contains(name.lower()), F.lit(name)).otherwise(result)
    return result


def _is_whole_number(text: Column) -> Column:
    digits = F.regexp_replace(text, r"^\+?0*", "")
    fits = (F.length(digits) < 20) | ((F.length(digits) == 20) & (digits <= _LARGEST_U64))
    return text.rlike(r"^\+?[0-9]+$") & fits


def version(model: Column) -> Column:
    """Version number inside a dashed model name, null if there is none.

    The first dash-separated part that is ``a.b`` or a whole number decides. A
    whole number followed by another one is ``major.minor``, unless the second
    has eight characters and so is a release date.
    """
    parts = F.split(F.lower(model), "-")

    def candidate(part: Column, position: Column) -> Column:
        following = F.get(parts, position + 1)
        halves = F.split(part, r"\.")
        dotted = (F.size(halves) == 2) & F.forall(halves, _is_whole_number)
        has_minor = F.coalesce(_is_whole_number(following) & (F.length(following) != 8), F.lit(False))
        return (
            F.when(part.contains("."), F.when(dotted, part))
            .when(_is_whole_number(part), F.when(has_minor, F.concat_ws(".", part, following)).otherwise(part))
        )

    found = F.filter(F.transform(parts, candidate), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def short_name(model: Column) -> Column:
    """``claude-opus-4-1-20250805`` -> ``Opus 4.1``; unknown families stay as they are."""
    name = family(model)
    return F.when(name.isNotNull(), F.concat_ws(" ", name, version(model))).otherwise(model)


def short_names(models: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(models, short_name), separator)


def status_name(display_name: Column) -> Column:
    """Family, or the text after the last ``-`` or ``/``."""
    return F.coalesce(family(display_name), F.element_at(F.split(display_name, "[-/]"), -1))
