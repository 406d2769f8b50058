"""String and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus import fixed

# Every Unicode space, as a whitespace split of Python text sees it.
SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
ALPHABETIC = r"^\p{L}+$"
_OTHER = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
TOPIC_RUNS = rf"(?<!{_OTHER})[\p{{L}},]{{4,}}+(?!{_OTHER})"  # letters and commas between spaces


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACES}|{SPACES}$", "")


def clean_code(col: Column, drop: tuple[str, ...] = (".00",)) -> Column:
    """Trim a code and remove every literal occurrence of the given pieces."""
    col = strip(col)
    for piece in drop:
        col = F.replace(col, F.lit(piece), F.lit(""))
    return strip(col)


def is_code(col: Column) -> Column:
    """Starts like an occupation code; NULL counts as no."""
    return F.coalesce(col.rlike(fixed.CODE_PATTERN), F.lit(False))


def parent_code(col: Column, length: int = 7) -> Column:
    return F.substring(col, 1, length)


def normalize_name(col: Column, tail: str = fixed.NAME_TAIL) -> Column:
    """Lower case, trimmed, without trailing characters of the ``tail`` set."""
    return strip(F.rtrim(strip(F.lower(col)), F.lit(tail)))


def unwrap_url(col: Column, wrapper: str = r"https://www\.google\.com/search\?q=") -> Column:
    return F.regexp_replace(col, wrapper, "")


def percent_encode(col: Column) -> Column:
    """Percent-encoding that keeps ``/`` and ``~`` and writes a space as ``%20``."""
    out = F.url_encode(col)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def search_url(title: Column, base: str, suffix: str = "") -> Column:
    return F.concat(F.lit(base), percent_encode(title), F.lit(suffix))


def join_sections(tasks: Column, skills: Column) -> Column:
    """Description text of an occupation; never NULL."""
    blank = F.lit("")
    return F.concat(
        F.lit("Tasks: "), F.coalesce(tasks, blank), F.lit(". Skills: "), F.coalesce(skills, blank)
    )


def credential_type(col: Column) -> Column:
    """Program type from a credential's wording; the first rule that fits wins."""
    low = F.lower(col)
    has = low.contains
    return (
        F.when(has("short"), "certificate")
        .when(has("aas") & has("certificate"), "associate_or_certificate")
        .when(has("aas"), "associate")
        .when(has("certificate"), "certificate")
        .otherwise("unknown")
    )


def preview(col: Column, length: int, tail: str = "") -> Column:
    return F.concat(F.substring(col, 1, length), F.lit(tail)) if tail else F.substring(col, 1, length)


def title_with_pay(title: Column, wage: Column) -> Column:
    """``Title — $68k``."""
    return F.concat(title, F.lit(" — $"), F.round(wage / 1000).cast("bigint").cast("string"), F.lit("k"))


def words(col: Column) -> Column:
    """Distinct lower-case words, punctuation kept."""
    return F.array_distinct(F.split(F.lower(col), SPACES))


def _member(word: Column, listed: list[str]) -> Column:
    return word.isin(listed)


def longest_first(array: Column) -> Column:
    """Strings by falling length, equal lengths in alphabetical order."""
    keyed = F.transform(array, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.transform(F.sort_array(keyed), lambda s: s["w"])


def skill_words(col: Column, stopwords: list[str] = fixed.GAP_STOPWORDS) -> Column:
    """Distinct words that can name a skill, longest first: more than four letters, only
    letters."""
    kept = F.filter(
        words(col),
        lambda w: (F.length(w) > 4) & w.rlike(ALPHABETIC) & ~_member(w, stopwords),
    )
    return longest_first(kept)


def skill_gap(source_words: Column, target_skill_words: Column, n: int = 6) -> Column:
    """The longest target skill words the source text does not contain; the target words
    come sorted, and the difference keeps their order."""
    return F.slice(F.array_except(target_skill_words, source_words), 1, n)


def topic_tokens(
    col: Column,
    stopwords: list[str] = fixed.TOPIC_STOPWORDS,
    headings: list[str] = fixed.TOPIC_HEADINGS,
) -> Column:
    """Tokens for topic models: headings cut, short, stop and non-letter tokens dropped,
    comma-joined words separated."""
    for heading in headings:
        col = F.replace(col, F.lit(heading), F.lit(""))
    # One pass finds the runs between spaces that hold only letters and commas, at least four; what they hold between commas
    # is checked below, where stop words go too, so that no token is looked at twice.
    kept = F.regexp_extract_all(col, F.lit(TOPIC_RUNS), F.lit(0))
    pieces = F.split(F.lower(F.array_join(kept, ",")), ",")
    return F.filter(pieces, lambda t: (F.length(t) > 1) & ~_member(t, stopwords))


def uni_and_bigrams(tokens: Column) -> Column:
    pairs = F.zip_with(
        tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(tokens, F.slice(pairs, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))


def parse_codes(raw: Column, valid: Column | None = None, default: str = fixed.GENERAL) -> Column:
    """JSON array of codes, restricted to valid ones; ``[default]`` when nothing is left."""
    fallback = F.array(F.lit(default))
    codes = F.from_json(raw, "array<string>")
    return valid_codes(codes, valid, default) if valid is not None else F.coalesce(codes, fallback)


def valid_codes(codes: Column, valid: Column, default: str = fixed.GENERAL) -> Column:
    kept = F.filter(codes, lambda c: F.array_contains(valid, c) | (c == default))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))
