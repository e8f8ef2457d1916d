"""Token sequences: arrays of strings tagged `C:` for a command and `T:` for text.

The lexers give the flat sequence that a parsed formula's nodes have in document order. Braces, `$`, `&`, white
space and comments leave no token, nor do the commands of IGNORED. What a lexer can't know differs from a full
TeX engine's tree: macros that the text defines are not expanded, infix primitives stay where they stand,
arguments keep their source order. A text command's argument is one token up to the first brace, command or active
character in it, and characters from there on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"

#: Commands and environments without a token of their own.
IGNORED = [
    "displaymath", "bgroup", "egroup", "math", "text", "nulldelimiterspace", "kern", "vphantom", "hphantom", "hfill", "vfill", "hbox",
    "align", "aligned", "gathered", "active::&", "#document", "document", "rm", "par", "None", "mathord", "array",
]
#: Names of the characters that are commands.
ACTIVE = {"^": "active::^", "_": "active::_", "~": "active::~"}
#: Commands that may have an argument in brackets.
BRACKETED = ["sqrt", "xrightarrow", "xleftarrow"]

#: A text command with the first run of its argument; a start or end of an environment; a command; a character.
LEXEME = r"\\text[A-Za-z]*\s*\{[^{}\\$&~^_]*|\\(?:begin|end)\s*\{[^{}]*\}|\\[A-Za-z]+|\\[^A-Za-z]|[^\s$&]"
#: What goes before that: comments, columns of arrays, spaces after line ends; and, where trees don't matter, brackets of arguments.
COMMENT = (r"(?<!\\)((?:\\\\)*)%[^\n]*\n?", "$1")
COLUMNS = (r"\\begin\s*\{(array|tabular)\}\s*(?:\[[^\]]*\]\s*)?\{[^{}]*\}", r"\\begin{$1}")
SPACING = (r"(\\\\)\s*\[\s*[0-9.]+\s*[a-z][a-z]\s*\]", "$1")
OPTIONAL = (rf"(?<!\\)((?:\\\\)*\\(?:{'|'.join(BRACKETED)}))\s*\[((?:[^\]{{}}]|\{{[^{{}}]*\}})*)\]", "$1{$2}")


def _balanced(parts: Column) -> Column:
    """Whether braces and environments match, by a stack of what is open."""
    environment = lambda p: F.regexp_extract(p, r"\{([^{}]*)\}$", 1)
    text_run = lambda p: p.startswith("\\text") & p.contains("{")
    begin, end = (lambda p: p.rlike(r"^\\begin\s*\{"), lambda p: p.rlike(r"^\\end\s*\{"))
    marks = F.filter(parts, lambda p: p.isin("{", "}") | text_run(p) | begin(p) | end(p))

    def step(state: Column, p: Column) -> Column:
        stack, closes = state["stack"], (p == "}") | end(p)
        opened = F.when(begin(p), environment(p)).otherwise("{")
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
        fits = ~closes | (top == F.when(p == "}", "{").otherwise(environment(p)))
        left = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.struct((state["ok"] & fits).alias("ok"), F.when(closes, left).otherwise(F.concat(stack, F.array(opened))).alias("stack"))

    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("stack"))
    return F.aggregate(marks, start, step, lambda s: s["ok"] & (F.size(s["stack"]) == 0))


def latex_tokens(text: Column) -> Column:
    """Tokens of a formula; none for null, and null where braces or environments don't match."""
    none = F.array().cast("array<string>")

    def of(part: Column) -> Column:
        text_name, run = F.regexp_extract(part, r"^\\(text[A-Za-z]*)\s*\{", 1), F.regexp_extract(part, r"\{([^{}]*)$", 1)
        begin, name = F.regexp_extract(part, r"^\\begin\s*\{([^{}]*)\}$", 1), F.substring(part, 2, 1 << 30)
        command = lambda n: F.when(n.isin(IGNORED) | (n == ""), none).otherwise(F.array(F.concat(F.lit("C:"), n)))
        active = F.array(F.concat(F.lit("C:active::"), part))
        return (
            F.when(part.isin("{", "}"), none)
            .when(text_name != "", F.concat(command(text_name), F.when(run != "", F.array(F.concat(F.lit("T:"), run))).otherwise(none)))
            .when(part.rlike(r"^\\(begin|end)\s*\{"), command(begin))
            .when(part.startswith("\\"), command(name))
            .when(part.isin(list(ACTIVE)), active)
            .otherwise(F.array(F.concat(F.lit("T:"), part)))
        )

    source = F.coalesce(text, F.lit(""))
    for pattern, to in (COMMENT, COLUMNS, SPACING, OPTIONAL):
        source = F.regexp_replace(source, pattern, to)
    parts = F.regexp_extract_all(source, F.lit(LEXEME), F.lit(0))
    return F.when(_balanced(parts), F.flatten(F.transform(parts, of)))


def character_tokens(text: Column) -> Column:
    """A text token for each character but spaces."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: (c != "") & (c != " "))
    return F.transform(kept, lambda c: F.concat(F.lit("T:"), c))


def word_tokens(text: Column) -> Column:
    """A text token for each run of letters and digits, in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.concat(F.lit("T:"), w))


def framed(tokens: Column) -> Column:
    """Tokens in one string, each between separators, so that a run of tokens is a substring. Null tokens and
    sequences without tokens have none."""
    return F.concat(F.lit(SEPARATOR), F.array_join(tokens, SEPARATOR), F.lit(SEPARATOR))
