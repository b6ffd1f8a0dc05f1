"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case, acronym and letter-digit boundaries, applied in this order.
BOUNDARIES = [r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"]
SEPARATORS = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_identifier(text: Column | str) -> Column:
    """Lower-case words of an identifier or of any string, in order."""
    x = _col(text)
    for boundary in BOUNDARIES:
        x = F.regexp_replace(x, boundary, "$1 $2")
    return F.filter(F.split(F.lower(x), SEPARATORS), lambda w: w != "")


def _drop(word: Column, n: int) -> Column:
    return word.substr(F.lit(1), F.length(word) - n)


def stem(word: Column | str) -> Column:
    """Light stem of one lower-case word; the first rule that fits wins."""
    w = _col(word)
    n = F.length(w)
    return (
        F.when(n < 4, w)
        .when(w.endswith("ies"), F.concat(_drop(w, 3), F.lit("y")))
        .when(w.rlike("(?:[sxz]|ch|sh)es$"), _drop(w, 2))
        .when(w.endswith("s") & ~w.rlike("(?:ss|us|is)$"), _drop(w, 1))
        .when(w.endswith("ing") & (n >= 6), _drop(w, 3))
        .when(w.endswith("ed") & (n >= 5), _drop(w, 2))
        .otherwise(w)
    )


def stemmed_words(text: Column | str) -> Column:
    return F.transform(split_identifier(text), stem)


def tokenize(text: Column | str) -> Column:
    """Searchable tokens: stemmed words of two characters or more that are not numbers; repeats stay."""
    return F.filter(stemmed_words(text), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{N}+$"))


def last_member(name: Column | str) -> Column:
    """What follows the last dot."""
    return F.substring_index(_col(name), ".", -1)


def name_keys(name: Column | str) -> Column:
    """Three normal forms of a name: lower case, without punctuation, joined stems."""
    n = _col(name)
    return F.array(F.lower(n), F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}]", ""), F.array_join(stemmed_words(n), ""))


def exact_keys(name: Column | str) -> Column:
    """Up to six keys under which a name or a term is matched exactly, its last member included."""
    return F.array_distinct(F.filter(F.concat(name_keys(name), name_keys(last_member(name))), lambda k: k != ""))


def chunk_id(file: Column, start: Column, end: Column, kind: Column, name: Column) -> Column:
    """First 12 hex digits of SHA-256 over file:start-end:kind:name."""
    return F.substring(F.sha2(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), kind, F.lit(":"), F.coalesce(name, F.lit(""))), 256), 1, 12)


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(_col(text), "UTF-16LE")) / 2).cast("int")


def judged_code(content: Column | str, cap: int = 6000, marker: str = "\n[truncated]") -> Column:
    """Content within `cap` UTF-16 units, cut before a character that would pass it, plus a marker."""
    c = _col(content)
    short = F.substring(c, 1, cap)
    over = F.greatest(utf16_length(short) - cap, F.lit(0))
    # every astral character too many takes two units; drop from the end until it fits
    fitted = F.aggregate(F.sequence(F.lit(1), F.greatest(over, F.lit(1))), short, lambda acc, _: F.when(utf16_length(acc) > cap, acc.substr(F.lit(1), F.length(acc) - 1)).otherwise(acc))
    return F.when(utf16_length(c) <= cap, c).otherwise(F.concat(fitted, F.lit(marker)))


def sanitize_inline(text: Column | str) -> Column:
    """Control characters as U+FFFD, so that one line of output stays one line."""
    return F.regexp_replace(_col(text), r"[\u0000-\u001F\u007F-\u009F\u2028\u2029]", "\uFFFD")


def longest_backtick_run(text: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_col(text), F.lit("(`+)"), 1), F.length)), F.lit(0))


def fence_for(text: Column | str) -> Column:
    """A Markdown fence longer than any run of backticks inside; three at least."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(text) + 1))


def code_span(text: Column | str) -> Column:
    """An inline code span that its content cannot end; the blanks inside belong to the marks."""
    t = sanitize_inline(text)
    ticks = F.repeat(F.lit("`"), longest_backtick_run(t) + 1)
    return F.concat(ticks, F.lit(" "), t, F.lit(" "), ticks)


def directory_of(path: Column | str) -> Column:
    p = _col(path)
    return F.when(F.instr(p, "/") == 0, "").otherwise(F.regexp_replace(p, "/[^/]*$", ""))


def top_level_of(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", 1)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension_of(path: Column | str) -> Column:
    """Last extension with its dot; '' where the base name has none or only starts with a dot."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]*)$", 1)


def normalize_path(path: Column) -> Column:
    """Segments with '.' and '..' resolved; leading '..' stay."""
    def step(acc: Column, s: Column) -> Column:
        back = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(s.isin("", "."), acc).when((s == "..") & back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def is_test_file(path: Column | str) -> Column:
    """Whether a path names a test: by base name, or by a test directory above it."""
    segments = F.split(_col(path), "/")
    above = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return base_name(path).rlike(r"\.(test|spec)\.[^.]+$|^test_.+\.py$|_test\.py$") | F.arrays_overlap(above, F.array(*map(F.lit, ("tests", "__tests__", "test"))))


def score_label(relevance: Column, score: Column) -> Column:
    """The judged relevance, else the score, with two decimals."""
    return F.format_string("%.2f", F.coalesce(relevance, score))


def location(file: Column, start: Column, end: Column, name: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.when(name.isNotNull(), F.concat(F.lit(" "), sanitize_inline(name))).otherwise(""))


def signal_pairs(signals: Column) -> Column:
    """Entries of a name -> value map, by name."""
    return F.array_sort(F.map_entries(signals))
