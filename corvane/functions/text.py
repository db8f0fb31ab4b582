"""Tokens, paths, prefixes and payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is not a letter or digit separates tokens; so does the underscore.
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"

# File extensions and the languages they stand for.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c": "c",
    ".rb": "ruby",
    ".cs": "csharp",
    ".php": "php",
    ".scala": "scala",
}
# Directories that are not indexed.
SKIPPED_DIRECTORIES = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".next", "coverage", ".pytest_cache", "migrations")
# Fixed value: the order in which a reference's extension is tried.
REFERENCE = r"(?i)[\p{L}\p{N}_./\\-]*\.(?:py|js|jsx|ts|tsx|java|go|rs|cpp|cc|cxx|c|rb|cs|php|scala)(?![\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null and empty text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_TOKENS), lambda t: t != "")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_references(question: Column) -> Column:
    """Paths that a question names, with forward slashes and without leading dots and slashes; repeats stay."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(REFERENCE), F.lit(0))
    return F.filter(F.transform(found, lambda r: F.regexp_replace(slashed(r), r"^[./]+", "")), lambda r: r != "")


def path_matches(path: Column, references: Column) -> Column:
    """Is the path one of the references, or does it end with a slash and one?"""
    own = slashed(path)
    return F.exists(references, lambda r: (own == r) | own.endswith(F.concat(F.lit("/"), r)))


def path_suffixes(path: Column) -> Column:
    """All ends of a path that begin at a segment: what a reference can name it by."""
    parts = F.split(slashed(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def language(path: Column) -> Column:
    """By the last suffix, whatever its case; null if it is none of LANGUAGES."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.nullif(suffix, F.lit("")))


def in_skipped_directory(path: Column) -> Column:
    """Is a directory on the way to the file one of SKIPPED_DIRECTORIES? The file's own name doesn't count."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def context_prefix(path: Column, parent: Column, name: Column) -> Column:
    return F.concat_ws(" > ", path, F.nullif(parent, F.lit("")), F.nullif(name, F.lit("")))


def sparse_text(prefix: Column, content: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def dense_text(prefix: Column, content: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def unified_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Lines as line splitting of Unicode text gives them: no empty one after a final break."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def verdict(text: Column) -> Column:
    """A judge's answer in capitals without white space around; null (the judge failed) accepts."""
    return F.coalesce(F.upper(stripped(text)), F.lit("YES"))


# Each phase's band of percent.
BANDS = {"cloning": (0, 10), "diffing": (10, 15), "chunking": (15, 35), "embedding": (35, 80), "upserting": (80, 98), "done": (100, 100), "error": (0, 0)}
FINAL_PHASES = ("done", "error")


def percent(phase: Column, current: Column, total: Column) -> Column:
    """Progress within the phase's band, rounded half to even; a total of zero is no progress; an unknown phase has band 0 to 0."""
    low = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, v[0])]), phase), F.lit(0))
    high = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, v[1])]), phase), F.lit(0))
    share = F.when((total > 0), F.least(F.greatest(current / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.bround(low + (high - low) * F.when(phase.isin(*FINAL_PHASES), 0.0).otherwise(share)).cast("int")


def is_final(event: Column) -> Column:
    """Does a progress event (JSON) end its stream? Malformed events don't."""
    return F.coalesce(F.get_json_object(event, "$.phase").isin(*FINAL_PHASES), F.lit(False))


def pushed_to_default(push: Column) -> Column:
    return push["ref"] == F.concat(F.lit("refs/heads/"), F.coalesce(push["repository"]["default_branch"], F.lit("main")))


def clone_url(url: Column) -> Column:
    """Without the .git that a push's URL ends with."""
    return F.regexp_replace(url, r"\.git$", "")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def band_of_score(score: Column) -> Column:
    return F.when(score >= 0.8, "green").when(score >= 0.6, "amber").otherwise("red")
