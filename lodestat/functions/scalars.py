"""Scalar rules of session analytics, each as a function from columns to a column.

All stay in the JVM. Where a rule tells null from zero, so does its column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is used: an expression used twice is worked out twice."""
    return F.get(F.transform(F.array(value), use), 0)


# --- reading values ---------------------------------------------------------------------------------------
def number_of_text(text: Column) -> Column:
    """F1 on a JSON scalar as text: a finite number, or text that is one, counts; all else is 0.

    Booleans read `true`/`false` and never match; hexadecimal text counts as 0.
    """
    value = F.when(F.trim(text).rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(value.isNotNull() & (F.abs(value) < float("inf")), value).otherwise(0.0)


def json_text(variant: Column | str, path: str) -> Column:
    """A scalar (or JSON) at a path of a variant as text; null where it is absent or null."""
    return F.try_variant_get(variant, path, "string")


def json_number(variant: Column | str, path: str) -> Column:
    """F1 at a path of a variant."""
    return number_of_text(json_text(variant, path))


def text_or_empty(text: Column) -> Column:
    """null reads as the empty text; other scalars are already text."""
    return F.coalesce(text, F.lit(""))


def name_or_unknown(text: Column) -> Column:
    """an empty or missing name reads `unknown`."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))


def kind_of(variant: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on, of a variant."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^[A-Z]+", 0)


# --- tokens -----------------------------------------------------------------------------------------------
def hit_rate(read: Column, fresh: Column) -> Column:
    """read / (read + input), 0 where that is not positive."""
    return F.when(read + fresh > 0, read / (read + fresh)).otherwise(0.0)


def strict_hit_rate(read: Column, fresh: Column, write: Column, empty: float | None = 0.0) -> Column:
    """read / (read + input + write); `empty` where that is not positive."""
    return F.when(read + fresh + write > 0, read / (read + fresh + write)).otherwise(F.lit(empty).cast("double"))


def usage_tokens(fresh: Column, output: Column, read: Column) -> Column:
    """input + output + cache read."""
    return fresh + output + read


def context_tokens(fresh: Column, read: Column, write: Column) -> Column:
    """F8: input + cache read + cache write."""
    return fresh + read + write


def estimate_tokens(chars: Column, octets: Column) -> Column:
    """a quarter of the ASCII characters plus the others, told by the bytes beyond one a character."""
    other = F.greatest((octets - chars) / F.lit(2.0), F.lit(0.0))
    return F.greatest(chars - other, F.lit(0.0)) / F.lit(4.0) + other


def non_negative(value: Column) -> Column:
    """negative and NaN count as 0."""
    return F.when(F.isnan(value.cast("double")) | (value < 0), F.lit(0)).otherwise(value)


def round_sig3(value: Column) -> Column:
    """three significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 2)
    return F.when(value == 0, 0.0).otherwise(F.round(value / scale) * scale)


def relative_delta(now: Column, before: Column) -> Column:
    """the change as a part of what was; null without a base above 0."""
    return F.when(before > 0, (now - before) / before)


def pp_delta(now: Column, before: Column) -> Column:
    """F35 of rates: the change in percentage points; null where either rate is missing."""
    return (now - before) * 100


# --- time -------------------------------------------------------------------------------------------------
def at(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(ms.cast("long"))


def local_date(ms: Column) -> Column:
    """F9 as a date of the session's time zone."""
    return F.to_date(at(ms))


def local_date_key(ms: Column) -> Column:
    """yyyy-MM-dd, empty where the time is missing."""
    return F.coalesce(F.date_format(at(ms), "yyyy-MM-dd"), F.lit(""))


def local_weekday(ms: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(at(ms)) - 1


def local_hour(ms: Column) -> Column:
    """F10."""
    return F.hour(at(ms))


def midnight_ms(day: Column) -> Column:
    """Epoch milliseconds of a date's local midnight, whatever the length of its day."""
    return F.unix_millis(day.cast("timestamp"))


def wall_duration_ms(created: Column, updated: Column) -> Column:
    """updated - created if positive, else null."""
    return F.when(updated > created, updated - created)


# --- paths ------------------------------------------------------------------------------------------------
def last_segment(path: Column) -> Column:
    """the last part between separators, or the whole where there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, r"[\\/]"), lambda x: x != ""), F.lit(-1)), path)


def normal_path(path: Column) -> Column:
    """one kind of separator, none doubled or at the end, and an upper-case drive letter."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    bare = F.when(F.length(slashes) > 1, F.regexp_replace(slashes, "/$", "")).otherwise(slashes)
    return F.when(bare.rlike("^[a-z]:"), F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 2**30))).otherwise(bare)


def redacted_home(path: Column, home: str) -> Column:
    """the home folder reads `~`; an empty home redacts nothing."""
    if not home:
        return path
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 2**30))).otherwise(path)


# --- parts of messages ------------------------------------------------------------------------------------
def tool_name(name: Column, legacy: Column) -> Column:
    """the name, else the legacy key; null where both are empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(legacy, F.lit("")))


def tool_status(variant: Column) -> Column:
    """text as it is, anything else `unknown`."""
    status = F.try_variant_get(variant, "$.state.status", "variant")
    return F.when(kind_of(status) == "STRING", json_text(variant, "$.state.status")).otherwise("unknown")


def text_blocks(variant: Column, path: str) -> Column:
    """The texts of the `text` blocks of an array, joined by a blank line; null where the path holds no array."""
    blocks = F.try_variant_get(variant, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: json_text(b, "$.type") == "text"), lambda b: json_text(b, "$.text"))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n\n")


def tool_output_text(variant: Column) -> Column:
    """F16: the output in the metadata where there is one, else the text blocks."""
    return F.coalesce(F.nullif(json_text(variant, "$.state.metadata.output"), F.lit("")), text_blocks(variant, "$.state.content"), F.lit(""))


def message_text(variant: Column) -> Column:
    """`text` where it is text, else the text parts joined by a blank line."""
    own = F.when(kind_of(F.try_variant_get(variant, "$.text", "variant")) == "STRING", json_text(variant, "$.text"))
    return F.coalesce(own, text_blocks(variant, "$.content"), F.lit(""))


REASONING_CHARS, TOOL_CHARS = 100_000, 200_000
# A text that is cut off is a token too.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"?|\{\}|\[\]|[{}\[\],:]|[^{}\[\],:"]++'


# An object of scalars only, as long as its pattern may be without deep recursion.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_MEMBER = rf'({_STRING}):({_STRING}|[^{{}}\[\],:"]++)'
_FLAT, FLAT_CHARS = rf"^\{{{_MEMBER}(?:,{_MEMBER})*\}}$", 1000


def _over_lines(tokens: Column, chunk: Column) -> Column:
    """JSON tokens as text over lines. The depth goes from token to token; arrays are grown in chunks of about the cube root of the tokens, since each append copies what it is added to."""
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def add(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        shown = F.when(t.isin("{", "[", ","), F.concat(t, line(depth))).when(t.isin("}", "]"), F.concat(line(depth), t)).when(t == ":", ": ").otherwise(t)
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.array(shown)).alias("out"))

    def add_chunk(s: Column, number: Column) -> Column:
        start = F.struct(s["depth"].alias("depth"), F.expr("cast(array() as array<string>)").alias("out"))
        ended = lambda e: F.struct(e["depth"].alias("depth"), F.concat(s["out"], F.array(F.array_join(e["out"], ""))).alias("out"))
        return F.aggregate(F.slice(tokens, number * chunk + 1, chunk), start, add, ended)

    start = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("out"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / chunk).cast("int"))
    return F.array_join(F.aggregate(numbers, start, add_chunk, lambda s: s["out"]), "")


def pretty_json(variant: Column, most: int | None = None) -> Column:
    """F17 as searched: a variant as JSON over lines, each level two blanks further in; null where there is none.

    With `most`, its first so many characters: no more of the JSON is looked at, since lines only make it longer.
    """
    text = F.to_json(variant)
    text = F.left(text, F.lit(most)) if most else text
    sized = lambda tokens: F.get(F.transform(F.array(F.greatest(F.lit(16), F.ceil(F.cbrt(2 * F.size(tokens))).cast("int"))), lambda chunk: _over_lines(tokens, chunk)), 0)
    # worked out once, then used by name
    nested = lambda t: once(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), lambda tokens: F.when(F.size(tokens) > 0, sized(tokens)).otherwise(""))
    # the members of a flat object need no depth
    flat = lambda t: F.concat(F.lit("{"), F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), f"{_MEMBER}(,?)", "\n  $1: $2$3"), F.lit("\n}"))
    whole = once(text, lambda t: F.when((F.length(t) <= FLAT_CHARS) & t.rlike(_FLAT), flat(t)).otherwise(nested(t)))
    return F.when(variant.isNotNull() & (kind_of(variant) != "VOID"), F.left(whole, F.lit(most)) if most else whole)


def searchable_text(variant: Column, type_: Column) -> Column:
    """the message's text; for an assistant also reasoning, tool names, inputs and outputs, up to their limits."""
    parts = F.try_variant_get(variant, "$.content", "array<variant>")

    def of(p: Column) -> Column:
        kind = json_text(p, "$.type")
        tool = F.concat_ws("\n\n", *(F.nullif(x, F.lit("")) for x in (F.coalesce(tool_name(json_text(p, "$.name"), json_text(p, "$.tool")), F.lit("unknown")), F.coalesce(once(F.try_variant_get(p, "$.state.input", "variant"), lambda v: pretty_json(v, TOOL_CHARS)), F.lit("")), F.left(tool_output_text(p), F.lit(TOOL_CHARS)))))
        return F.when(kind == "reasoning", F.left(F.coalesce(json_text(p, "$.text"), F.lit("")), F.lit(REASONING_CHARS))).when(kind == "tool", tool).otherwise("")

    extra = F.when(type_ == "assistant", F.transform(parts, of))
    return F.array_join(F.filter(F.concat(F.array(message_text(variant)), F.coalesce(extra, F.expr("cast(array() as array<string>)"))), lambda t: t != ""), "\n\n")


def model_switch_detail(old: Column, new: Column) -> Column:
    """`from → to`, with `unknown` for what is missing."""
    return F.concat(name_or_unknown(old), F.lit(" → "), name_or_unknown(new))


# --- search -----------------------------------------------------------------------------------------------
#: Letters match in any case, those beyond ASCII too.
ANY_CASE = "(?iu)"


def literal_pattern(text: str, ignore_case: bool = True) -> str:
    """a pattern that matches the text itself."""
    return (ANY_CASE if ignore_case else "") + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def count_matches(text: Column, pattern: str) -> Column:
    """matches of a pattern, those of no width included."""
    return F.regexp_count(text, F.lit(pattern))


def escaped_html(text: Column) -> Column:
    """& first."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def snippet(text: Column, pattern: str, width: int = 120) -> Column:
    """`width` characters around the first match, which is marked; the three pieces are escaped one by one.

    The window begins so far before the match that it is in the middle, or at the text's start, and what of the
    match is beyond its end is left out. Of a match longer than the window, the window begins within the match.
    """
    match = F.regexp_extract(text, f"({pattern})", 1)
    begin, size, length = F.regexp_instr(text, F.lit(pattern)) - 1, F.length(match), F.length(text)
    low = F.greatest(begin - F.floor((F.lit(width) - size) / 2).cast("int"), F.lit(0))
    high = F.least(low + width, length)
    stop = F.least(begin + size, high)
    part = lambda a, b: escaped_html(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
    return F.concat(
        F.when(low > 0, "…").otherwise(""), part(low, begin), F.lit("<mark>"), part(begin, stop), F.lit("</mark>"), part(stop, high), F.when(high < length, "…").otherwise("")
    )


# --- export -----------------------------------------------------------------------------------------------
# What a spreadsheet takes for the start of a formula; characters that names of files can't have.
FORMULA = r"^[=+\-@\t\r]"
#: Of what is told where a tool's output was cut; {} is its length.
CUT_MARK = "...（截断，完整 {} 字符）"
NOT_IN_NAMES = r'[\\/:*?"<>|\x00-\x1f]'


def csv_field(text: Column) -> Column:
    """F33, first half: a quote before text that a spreadsheet would run; the writer does the quoting."""
    return F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def slug(title: Column, most: int = 60) -> Column:
    """the title with one blank for each white space, hyphens for what names of files can't have, at most `most` characters and no dot or blank at the end; `untitled-session` where nothing is left."""
    blanks = F.regexp_replace(title, r"[\t\n\r\f\x0b]+", " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(blanks, NOT_IN_NAMES, "-"), r"\s+", " "))
    return F.coalesce(F.nullif(F.regexp_replace(F.left(clean, F.lit(most)), "[. ]+$", ""), F.lit("")), F.lit("untitled-session"))


def download_name(created_ms: Column, title: Column, extension: str) -> Column:
    """<created date>-<slug>.<extension>; `unknown-date` where there is no date."""
    day = F.coalesce(F.nullif(local_date_key(created_ms), F.lit("")), F.lit("unknown-date"))
    return F.concat(day, F.lit("-"), slug(title), F.lit(f".{extension}"))


#: White space of documents, beyond ASCII too.
BLANK = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def is_blank(text: Column) -> Column:
    """Whether a text has nothing but white space."""
    return text.rlike(f"^{BLANK}*$")


def md_escape(text: Column) -> Column:
    """a backslash before what Markdown reads."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>#|~])", r"\\$1")


def md_quote(text: Column) -> Column:
    """every line behind `> `; a line of white space is `>`."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(is_blank(line), ">").otherwise(F.concat(F.lit("> "), line))), "\n")


def longest_backticks(text: Column) -> Column:
    """the longest run of backticks, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def md_fence(text: Column, language: str = "") -> Column:
    """a fence longer than any run of backticks inside, three at least."""
    def fenced(t: Column) -> Column:
        return once(F.when(F.contains(t, F.lit("```")), F.repeat(F.lit("`"), longest_backticks(t) + 1)).otherwise("```"), lambda fence: F.concat(fence, F.lit(f"{language}\n"), t, F.lit("\n"), fence))

    return once(text, fenced)


def one_line(text: Column) -> Column:
    """white space runs as one space."""
    return F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), "^ | $", "")


def local_minute(ms: Column, missing: str) -> Column:
    """yyyy-MM-dd HH:mm of the session's time zone; `missing` where there is no time above 0."""
    return F.when(ms > 0, F.date_format(at(ms), "yyyy-MM-dd HH:mm")).otherwise(missing)


def thousands(n: Column) -> Column:
    """a count with commas; 0 where it is not positive."""
    return F.when(n > 0, F.format_number(F.floor(n), 0)).otherwise("0")


def plain_number(n: Column) -> Column:
    """A number as documents show it: 12 for 12.0, no exponent for sizes between."""
    short = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when((F.abs(n) < 1e21) & ((F.abs(n) >= 1e-6) | (n == 0)), short).otherwise(n.cast("string"))


def _utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def cut_at(text: Column, most: int) -> Column:
    """the first `most` UTF-16 units, one less where that would cut a character in two."""
    raw = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(raw, 2 * most - 1, 2))
    units = F.lit(most) - F.when(last.between("D800", "DBFF"), 1).otherwise(0)
    return F.when(_utf16_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), units * 2), "UTF-16BE"))


def cut_notice(text: Column, most: int = 200) -> Column:
    """with `...` where it was longer."""
    return once(text, lambda t: F.when(_utf16_length(t) > most, F.concat(cut_at(t, most), F.lit("..."))).otherwise(t))


def cut_tool_output(text: Column, most: int = 4000) -> Column:
    """with the whole length where it was longer, which is in UTF-16 units."""
    told = lambda t: F.format_string(CUT_MARK.replace("{}", "%d"), _utf16_length(t))
    return once(text, lambda t: F.when(_utf16_length(t) > most, F.concat(cut_at(t, most), F.lit("\n"), told(t))).otherwise(t))


# Shapes of credentials: what stays before the secret, the secret's characters, the least number of them.
CREDENTIALS = (
    ("openai_key", "sk-", "[A-Za-z0-9_-]", 16),
    ("github_token", "gh[pousr]_", "[A-Za-z0-9]", 16),
    ("github_pat", "github_pat_", "[A-Za-z0-9_]", 16),
    ("slack_token", "xox[bpar]-", "[A-Za-z0-9-]", 10),
    ("slack_app", "xapp-", "[A-Za-z0-9-]", 10),
    ("stripe_key", "sk_live_", "[A-Za-z0-9]", 10),
    ("aws_key", "(?:AKIA|ASIA)", "[A-Z0-9]", 16),
    ("bearer", r"(?i:bearer)\s+", "[A-Za-z0-9._~+/=-]", 16),
    ("assignment", r"(?i:api[_-]?key|secret|token|password|passwd)[\"']?\s*[:=]\s*[\"']?", "[A-Za-z0-9._~+/=-]", 12),
)
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
#: What each credential and each key block begins with.
_BEGINNINGS = "|".join(["-----BEGIN ", *(prefix for _, prefix, _, _ in CREDENTIALS)])
#: A secret begins where no word goes on; the end of a terminal's colour code is no word.
_EDGE = r"(?:(?<![A-Za-z0-9_])|(?<=\x1b\[[0-9;]{0,8}m))"


def _shape(prefix: str, body: str, least: int) -> str:
    return f"{_EDGE}({prefix}){body}{{{least - 4},}}?({body}{{4}})(?!{body})"


def redacted(text: Column) -> Column:
    """F32: a secret keeps what tells its kind and its last four characters (`sk-…WXYZ`); key blocks go whole.

    A text that has the beginning of none of them is left as it is, by one look at it.
    """

    def hidden(t: Column) -> Column:
        t = F.regexp_replace(t, _PEM, "[private key]")
        for _, prefix, body, least in CREDENTIALS:
            t = F.regexp_replace(t, _shape(prefix, body, least), "$1…$2")
        return t

    return once(text, lambda t: F.when(t.rlike(_BEGINNINGS), hidden(t)).otherwise(t))


def credential_hits(text: Column) -> Column:
    """F32: how many secrets a text shows, by all shapes."""
    return sum((F.regexp_count(text, F.lit(_shape(p, b, n))) for _, p, b, n in CREDENTIALS), F.regexp_count(text, F.lit(_PEM)))
