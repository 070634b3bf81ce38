"""Column functions over text: normalisation, prompts, stop sequences, slugs and marker parsing."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_normalize(text: Column | str, form: str = "NFC") -> Column:
    """Unicode normalisation; an Arrow function, as Spark has none built in, which only texts with other characters than ASCII are sent to. Null stays null."""
    if form not in FORMS:
        raise ValueError(f"unknown normalisation form {form}")

    @pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    text = _column(text)
    return F.coalesce(normalize(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def casefold(text: Column | str) -> Column:
    """Full case folding, which differs from lower case on a few letters."""

    @pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.casefold())

    return fold(_column(text))


def _not_empty(text: Column, message: str) -> Column:
    return F.when(text == "", F.raise_error(F.lit(message)).cast("string")).otherwise(text)


def line_endings(text: Column | str) -> Column:
    """CR LF and lone CR become LF."""
    return F.replace(F.replace(_column(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def text_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_column(text), 256))


def safe_id(name: Column | str) -> Column:
    """Runs of characters other than ASCII letters, digits, _, . and - become one underscore; an empty name is an error."""
    return _not_empty(F.regexp_replace(_column(name), r"[^A-Za-z0-9_.\-]+", "_"), "a document id needs a character")


def truncate_at_stop(text: Column | str, stops: Sequence[str]) -> Column:
    """The text before the earliest of the stop sequences; empty stops count for nothing."""
    text = _column(text)
    places = [F.when(F.locate(s, text) > 0, F.locate(s, text)) for s in stops if s]
    if not places:
        return text
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), text).otherwise(F.substr(text, F.lit(1), first - 1))


def strip_prompt(text: Column | str, prompt: Column | str) -> Column:
    """The text without the prompt that it begins with."""
    text, prompt = _column(text), _column(prompt)
    return F.when(F.startswith(text, prompt), F.substr(text, F.length(prompt) + 1)).otherwise(text)


def executable_suffix(prompt: Column | str) -> Column:
    """What follows the last blank line."""
    return F.substring_index(_column(prompt), "\n\n", -1)


def inference_prompt(prompt: Column | str, description: Column | str) -> Column:
    """The prompt without newlines at its end; without a prompt, the trimmed description and a blank line."""
    described = F.concat(F.regexp_replace(_column(description), r"(?U)^\s+|\s+$", ""), F.lit("\n\n"))
    return F.coalesce(F.regexp_replace(_column(prompt), r"\n+\z", ""), described)


def append_completion(prompt: Column | str, completion: Column | str) -> Column:
    """Prompt and completion; a completion of characters that does not begin a line itself gets one of its own after a colon."""
    prompt, completion = _column(prompt), _column(completion)
    opens = F.regexp_replace(prompt, r"(?U)\s+\z", "").endswith(":") & (completion != "") & ~completion.startswith("\n")
    return F.concat(prompt, F.when(opens, F.lit("\n")).otherwise(F.lit("")), completion)


def signature_line(code: Column | str) -> Column:
    """The first line of the trimmed source, trimmed."""
    return F.trim(F.substring_index(F.regexp_replace(_column(code), r"(?U)^\s+", ""), "\n", 1))


def description_key(text: Column | str) -> Column:
    """Case-folded text with single spaces between words, for comparing descriptions."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


def check_marker(output: Column | str, marker: str = "CHECKS") -> Column:
    """(found, passed, total) of the first line "<marker> passed total"."""
    output = _column(output)
    pattern = rf"(?m)^\s*{marker} (\d+) (\d+)\s*$"
    number = lambda g: F.when(output.rlike(pattern), F.regexp_extract(output, pattern, g).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.struct(F.coalesce(output.rlike(pattern), F.lit(False)).alias("found"), number(1).alias("passed"), number(2).alias("total"))


def tagged(text: Column | str, tag: str) -> Column:
    """The content of the first <tag>...</tag>, over several lines; null without one."""
    found = F.regexp_extract(_column(text), rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    return F.when(_column(text).rlike(rf"(?s)<{tag}>.*?</{tag}>"), found)


def strip_fence(text: Column | str) -> Column:
    """The trimmed content of a text that is one fenced block as a whole; any other text stays as it is."""
    text = _column(text)
    fence = r"(?sU)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)


def slug(name: Column | str) -> Column:
    """Letters and digits in lower case; each run of other characters is one underscore, none at either end. A name without letters or digits is an error."""
    parts = F.regexp_replace(_column(name), r"[^\p{L}\p{N}]+", "_")
    return _not_empty(F.lower(F.regexp_replace(parts, r"^_|_$", "")), "a key needs a letter or digit")


def replace_all(text: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, _column(text))


def template(form: str, columns: Sequence[str]) -> Column:
    """A "{a} and {b}" template over columns; a null value is an error, braces double to stand for themselves."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(form):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in columns:
                raise ValueError(f"unknown column {name}")
            parts.append(F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(F.col(name).cast("string")))
    return F.concat(*parts) if parts else F.lit("")


def text_column(df, name: str) -> Column:
    """The column as a text: one that is there and holds strings, or an error at once; a null is an error when it is met."""
    kinds = dict(df.dtypes)
    if kinds.get(name) != "string":
        raise TypeError(f"{name} has to be a column of strings, not {kinds.get(name, 'missing')}")
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is null")).cast("string")).otherwise(F.col(name))


def prompt(opening: str, fields: Sequence[tuple[str, Column | str]], closing: str) -> Column:
    """The opening, a line "label: value" for each field and the closing, blank lines between; lists are joined by commas. A null value is an error."""
    lines = [F.concat(F.lit(f"{label}: "), F.when(_column(c).isNull(), F.raise_error(F.lit(f"{label} is null")).cast("string")).otherwise(_column(c))) for label, c in fields]
    return F.concat(F.lit(f"{opening}\n\n"), F.concat_ws("\n", *lines), F.lit(f"\n\n{closing}"))


#: The wording of the prompt that asks for an example of a task seed.
SEED_OPENING = "Create one training example from this semantic seed."
SEED_CLOSING = "Resolve minor ambiguity in the simplest sensible way. Return only <task> and <code>."
SEED_LABELS = (
    ("Input", "input_kind"),
    ("Task family", "task_family"),
    ("Operation tags", "operation_tags"),
    ("Operation", "operation"),
    ("Condition or relation", "condition"),
    ("Required output", "output_kind"),
    ("Edge behavior", "edge_behavior"),
    ("Implementation style", "implementation_style"),
    ("Additional constraint", "extra_constraint"),
    ("Concrete task detail", "task_detail"),
    ("Description style", "description_style"),
    ("Naming style", "naming_style"),
)


def seed_prompt() -> Column:
    """The prompt of rows with the fields of a task seed; operation_tags is a list."""
    return prompt(SEED_OPENING, [(label, F.array_join(name, ", ") if name == "operation_tags" else F.col(name)) for label, name in SEED_LABELS], SEED_CLOSING)


def exact_match(generated: Column | str, asked: Column | str, expected: Column | str) -> Column:
    """Whether a generated text is its prompt and the expected completion, character by character."""
    return _column(generated).eqNullSafe(F.concat(_column(asked), _column(expected)))


def bytes_per_token(n_bytes: Column | str, n_tokens: Column | str) -> Column:
    """Bytes over tokens; 0 where there are no tokens."""
    return F.when(_column(n_tokens) == 0, F.lit(0.0)).otherwise(_column(n_bytes) / _column(n_tokens))


def missing_tokens(required: Column | str, configured: Column | str) -> Column:
    """The required tokens (a list) that are not configured, once each, in order of their text."""
    return F.array_sort(F.array_except(_column(required), _column(configured)))


def append_missing(configured: Column | str, required: Column | str) -> Column:
    """The configured tokens, then the required ones that are not among them, in their order and once each."""
    return F.concat(_column(configured), F.array_except(_column(required), _column(configured)))
