"""Source files to chunks: structure first, then windows over long ones."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_prefix, lines, unified_newlines
from ..schemas import CHUNK_COLUMNS
from ..sources.shared import small_batches
from .batches import runs

# Longest chunk, window and overlap in lines; rows that a node has to span.
MOST_LINES, WINDOW, OVERLAP, LEAST_SPAN = 80, 60, 15, 2
# Fixed value: the name of a file that is one chunk.
MODULE = "module"
#: Bytes of source and files that a worker chunks at once; a longer file is chunked alone.
RUN_BYTES, RUN_FILES = 1 << 20, 256


def window_split(chunks: DataFrame, most: int = MOST_LINES, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of more than ``most`` lines become windows of ``window`` lines that overlap.

    The windows start every window - overlap lines up to the first that reaches the end; their
    prefix and name say which part they are, and their lines count on from the chunk's start.
    Null content is left as it is.
    """
    step = window - overlap
    cut = chunks.withColumn("_lines", lines(F.col("content")))
    count = F.size("_lines")
    last = F.ceil(F.greatest(count - window, F.lit(0)) / step).cast("int") * step
    starts = F.when(count > most, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array(F.lit(-1)))
    parts = cut.withColumn("_parts", F.size(starts)).select("*", F.posexplode(starts).alias("_i", "_at"))
    whole = F.col("_at") < 0
    label = F.format_string("part %d/%d", F.col("_i") + 1, F.col("_parts"))
    name = F.when(F.nullif("name", F.lit("")).isNull(), label).otherwise(F.concat("name", F.lit(" ("), label, F.lit(")")))
    changed = {
        "content": F.when(whole, F.col("content")).otherwise(F.array_join(F.slice("_lines", F.col("_at") + 1, window), "\n")),
        "context_prefix": F.when(whole, F.col("context_prefix")).otherwise(F.concat("context_prefix", F.lit(" > "), label)),
        "name": F.when(whole, F.col("name")).otherwise(name),
        "end_line": F.when(whole, F.col("end_line")).otherwise(F.col("start_line") + F.least(F.col("_at") + window, count) - 1),
        "start_line": F.when(whole, F.col("start_line")).otherwise(F.col("start_line") + F.col("_at")),
    }
    return parts.select(*[changed.get(c, F.col(c)).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns])


#: Chunk kinds by declaration keyword; class-like ones are entered, the others are not. An export statement is a chunk without a name, whatever it exports.
KEYWORDS = {
    "javascript": (r"(?:abstract\s+)?class\s+(\w+)", r"export\b|(?:async\s+)?function\s*\*?\s*(\w+)?|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|(?:static\s+|async\s+|get\s+|set\s+)*(?!if|for|while|switch|catch|return)(\w+)\s*\([^)]*\)\s*\{"),
    "java": (r"(?:[\w@]+\s+)*class\s+(\w+)", r"(?:[\w@]+\s+)*(?:interface|enum)\s+(\w+)|(?:public|private|protected|static|final|abstract|synchronized|[\w<>\[\],.?]+)\s+(?:[\w<>\[\],.?]+\s+)*(?!if|for|while|switch|catch|new|return)(\w+)\s*\([^;{]*\)\s*(?:throws[\w,.\s]+)?\{"),
    "go": (r"(?!)", r"func\s+(?:\([^)]*\)\s*)?(\w+)|type\s+(\w+)\s+(?:struct|interface)"),
    "rust": (r"(?!)", r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)|(?:pub(?:\([^)]*\))?\s+)?(?:struct|trait|enum)\s+(\w+)|(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([\w:<>, ]+?)\s*\{"),
    "cpp": (r"class\s+(\w+)[^;]*\{", r"struct\s+(\w+)[^;]*\{|[\w:<>*&~,\s]+?([\w:~]+)\s*\([^;{]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{"),
    "c": (r"(?!)", r"[\w*\s]+?(\w+)\s*\([^;{]*\)\s*\{"),
    "csharp": (r"(?:[\w]+\s+)*class\s+(\w+)", r"(?:[\w]+\s+)*interface\s+(\w+)|(?:public|private|protected|internal|static|virtual|override|async|[\w<>\[\],.?]+)\s+(?:[\w<>\[\],.?]+\s+)*(?!if|for|while|switch|catch|new|return)(\w+)\s*\([^;{]*\)\s*\{"),
    "php": (r"(?:abstract\s+|final\s+)*class\s+(\w+)", r"(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*function\s+&?(\w+)"),
    "scala": (r"(?:case\s+|abstract\s+|sealed\s+|final\s+)*class\s+(\w+)", r"(?:case\s+)?object\s+(\w+)|(?:sealed\s+)?trait\s+(\w+)|(?:override\s+|private\s+|protected\s+|final\s+|implicit\s+)*def\s+(\w+)"),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]
RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
RUBY = re.compile(r"\s*(def|class|module)\s+([\w.:?!=]+)")

Found = tuple[str, str | None, str | None, int, int]


def _python(source: str) -> list[Found]:
    """(kind, name, parent, first, last row) in source order: functions and classes; classes are entered with their name as parent."""
    out: list[Found] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = isinstance(child, ast.ClassDef)
                out.append(("class" if own else "function", child.name, parent, child.lineno - 1, child.end_lineno - 1))
                if own:
                    visit(child, child.name)
            else:
                visit(child, parent)

    visit(ast.parse(source), None)
    return out


def _blank(source: str, hash_comments: bool) -> str:
    """The source with comments and strings blanked out, line breaks kept, so that braces count."""
    pattern = r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`' + (r"|#[^\n]*" if hash_comments else "")
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _braces(source: str, language: str) -> list[Found]:
    """Declarations at the beginning of a line, each up to the brace that closes it."""
    clean = _blank(source, language == "php")
    classes, functions = (re.compile(x) for x in KEYWORDS[language])
    starts = [0, *(m.end() for m in re.finditer("\n", clean))]
    out: list[Found] = []

    def close(at: int) -> int:
        depth = 0
        for m in re.finditer(r"[{};]", clean[at:]):
            if m[0] == ";" and not depth:
                return at + m.start()
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if m[0] == "}" and depth <= 0:
                return at + m.start()
        return len(clean) - 1

    row, stack, skip = 0, [], -1
    while row < len(starts):
        begin = starts[row]
        text_at = begin + len(clean[begin:]) - len(clean[begin:].lstrip(" \t"))
        while stack and row > stack[-1][1]:
            stack.pop()
        if row > skip:
            parent = stack[-1][0] if stack else None
            kind = "class" if (m := classes.match(clean, text_at)) else "function" if (m := functions.match(clean, text_at)) else None
            if kind:
                name = next((g for g in m.groups() if g), None)
                last = clean.count("\n", 0, close(text_at))
                out.append((kind, name, parent, row, last))
                if kind == "class":
                    stack.append((name, last))
                else:
                    skip = last
        row += 1
    return out


def _ruby(source: str) -> list[Found]:
    out: list[list] = []
    opened: list[int | None] = []
    for row, line in enumerate(source.split("\n")):
        bare = re.sub(r"#.*$", "", line)
        if re.match(r"\s*end\b", bare) and opened:
            if (i := opened.pop()) is not None:
                out[i][4] = row
        elif RUBY_OPEN.search(bare) and not re.search(r"\bend\s*$", bare):
            m = RUBY.match(bare)
            around = [out[i] for i in opened if i is not None]
            if m and not any(x[0] == "function" for x in around):
                parent = next((x[1] for x in reversed(around) if x[0] == "class"), None)
                out.append(["class" if m[1] == "class" else "function", m[2], parent, row, row])
                opened.append(len(out) - 1)
            else:
                opened.append(None)
    return [tuple(x) for x in out]


def chunk_source(path: str, source: str, language: str) -> list[tuple]:
    """Chunk rows (path, language, kind, name, parent, first and last row, text) of one file; a file without a structured chunk is one module chunk, a blank one none.

    Rows count from 0, texts begin at the declaration itself. Nodes of fewer than three rows are entered but not emitted. Python is parsed
    exactly; for the other languages declarations are found by keywords and matching braces (or
    ends), which takes plain functions of every language in and calls what is in a class its own.
    """
    try:
        found = _python(source) if language == "python" else _ruby(source) if language == "ruby" else _braces(source, language)
    except (SyntaxError, ValueError, RecursionError):
        found = []
    rows = source.split("\n")
    out = [(path, language, kind, name, parent, a, b, "\n".join(rows[a : b + 1]).lstrip(" \t")) for kind, name, parent, a, b in found if b - a >= LEAST_SPAN]
    if not out and source.strip():
        out = [(path, language, "module", MODULE, None, 0, source.count("\n"), source)]
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files (file_path, source, language): structure, fallback and windows, columns CHUNK_COLUMNS."""

    names = ["file_path", "language", "chunk_type", "name", "parent", "start_line", "end_line", "content"]
    kinds = [pa.int32() if n.endswith("_line") else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 1, RUN_BYTES, RUN_FILES):
            rows = [r for f in part.to_pylist() for r in chunk_source(f["file_path"], f["source"], f["language"])]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    small_batches(files.sparkSession)
    usable = files.where(F.col("source").isNotNull() & F.col("language").isNotNull()).select("file_path", unified_newlines(F.col("source")).alias("source"), "language")
    found = usable.mapInArrow(run, "file_path string, language string, chunk_type string, name string, parent string, start_line int, end_line int, content string")
    shown = F.when(F.col("chunk_type") != "module", F.col("name"))  # a module's prefix is its path alone
    named = found.withColumn("context_prefix", context_prefix(F.col("file_path"), F.col("parent"), shown))
    return window_split(named.select(*CHUNK_COLUMNS))
